import numpy as np

from strandworks.llm import toxicity as X


def corpus(n, seed):
    r = np.random.default_rng(seed)
    texts, labels = [], []
    for i in range(n):
        words = ["".join(r.choice(["an", "he", "ti", "ou", "re", "st"], 3)) for _ in range(int(r.integers(5, 200)))]
        bad = i % 3 == 0
        if bad:
            for at in r.integers(0, len(words), 3):
                words[at] = "zarg" + "".join(r.choice(["ib", "ok", "um"], 2))
        texts.append(" ".join(words))
        labels.append(int(bad))
    return texts, labels


def test_gradients_match_differences():
    net = X.Net({"a": 0, "b": 1}, np.array([0.5, -0.2]), np.zeros(X.BUCKETS))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    look = net.lookup(["a", "b.", "zarg"])
    ids, y, w = np.array([[0, 2, 1], [1, 0, -1]]), np.array([1.0, 0.0]), np.array([1.0, 2.0])

    def loss():
        z = net.forward(net.inputs(look)[1], ids)[0]
        return float((w * (np.logaddexp(0, z) - y * z)).sum() / w.sum())

    g = net.gradients(look, ids, y, w)
    for k in net.p:
        for at in [np.unravel_index(int(np.abs(g[k]).argmax()), g[k].shape)]:
            old = net.p[k][at]
            net.p[k][at] = old + 1e-4
            up = loss()
            net.p[k][at] = old - 1e-4
            down = loss()
            net.p[k][at] = old
            assert abs((up - down) / 2e-4 - g[k][at]) < 3e-3 * max(0.05, abs(g[k][at])), k


def test_held_out_accuracy_with_unseen_words():
    net = X.train(*corpus(240, 1))
    texts, labels = corpus(120, 2)
    got = X.Scorer(net)(texts) >= X.THRESHOLD
    assert (got == np.array(labels, bool)).mean() > 0.95


def test_windows_cover_whole_texts():
    for n in (0, 1, 31, 32, 33, 64, 65, 96, 97, 1000):
        spans = X.windows(n)
        assert spans[0][0] == 0 and spans[-1][1] == n and {i for a, b in spans for i in range(a, b)} == set(range(n))


def test_constant_labels_and_odd_rows(spark):
    assert X.train([], []) == 0.0 and X.train(["a"], [1]) == 1.0
    docs = spark.createDataFrame([(1, None, "s"), (1, "", "s"), (None, "x " * 30000, "s"), (3, "y", "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    net = X.fit(docs, labels)
    assert [r.score for r in X.score(docs, net).collect()] == [0.0] * 4
    trained = X.train(*corpus(60, 3))
    got = X.score(docs, trained).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got) and got[0].score == got[1].score
    assert X.score(docs.limit(0), trained).count() == 0


def plain_score(net, text):
    """One word, one window, one unit at a time, in double precision."""
    import math

    p = {k: v.astype(float) for k, v in net.p.items()}
    h, sig = X.HIDDEN, lambda x: 1 / (1 + math.exp(-x))

    def word(w):
        b = X.bare(w)
        grams = [p["gram"][g] for g in X.trigrams([b])[0]]
        return np.concatenate([p["word"][net.vocab.get(b, len(net.vocab))], np.mean(grams, axis=0), np.max(grams, axis=0)])

    def run(words, u, side):
        state, out = np.zeros(h), []
        for w in words:
            x = (word(w) @ p["wx"] + p["bx"])[side * 3 * h : (side + 1) * 3 * h]
            g = state @ u
            new = np.zeros(h)
            for i in range(h):
                z, r = sig(x[i] + g[i]), sig(x[h + i] + g[h + i])
                new[i] = z * state[i] + (1 - z) * math.tanh(x[2 * h + i] + r * g[2 * h + i])
            state = new
            out.append(state)
        return out

    best, words = -math.inf, text.lower().split()
    for a in range(0, max(1, len(words) - (X.WINDOW - X.STRIDE)), X.STRIDE):
        part = words[a : a + X.WINDOW]
        hs = [np.concatenate(x) for x in zip(run(part, p["uf"], 0), run(part[::-1], p["ub"], 1)[::-1])]
        weights = [math.exp(np.tanh(v @ p["att"]) @ p["va"]) for v in hs]
        pooled = sum(w * v for w, v in zip(weights, hs)) / sum(weights) if hs else np.zeros(2 * h)
        best = max(best, pooled @ p["out"] + p["b0"][0])
    return sig(net.scale[0] * best + net.scale[1])


def test_scores_match_a_plain_network():
    r = np.random.default_rng(3)
    word = lambda: "".join(r.choice(list("abcdefg"), int(r.integers(1, 7)))) + r.choice(["", ".", "!"])
    texts = [" ".join([word() for _ in range(40)] + (["zargok"] * 2 if i % 3 == 0 else [])) for i in range(60)]
    net = X.train(texts, [int(i % 3 == 0) for i in range(60)])
    new = ["", "zargok", " ".join(word() for _ in range(64)), " ".join(word() for _ in range(65)), " ".join([word() for _ in range(200)] + ["Zargok!"] + [word() for _ in range(30)]), "\u00e9t\u00e9 " * 10]
    assert np.allclose(X.Scorer(net)(new), [plain_score(net, t) for t in new], atol=1e-4)
