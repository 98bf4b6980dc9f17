import random

import corpus_pipeline as C
from strandworks.llm import near_copies as N


def brute_sets(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def planted(r, word):
    """Texts with copies of one to twelve changed words, in chains too; ids fall along a chain."""
    texts = []
    for _ in range(30):
        words = [word() for _ in range(r.choice([40, 120, 400]))]
        for _ in range(5):
            texts.append(" ".join(words))
            for _ in range(r.randint(1, max(1, len(words) // 60))):
                words[r.randrange(len(words))] = word()
    return texts + [texts[0], texts[0].upper(), None, "", " \t", "one two", "One  two", "three"]


def test_components_match_all_pairs(spark):
    r = random.Random(4)
    texts = planted(r, lambda: "".join(r.choice("abcdefgh") for _ in range(5)))
    ids = list(range(1000, 1000 + len(texts)))
    r.shuffle(ids)
    sets = [brute_sets(t) for t in texts]
    root = {i: i for i in ids}

    def find(i):
        return i if root[i] == i else find(root[i])

    differing = 0
    for x in range(len(ids)):
        for y in range(x):
            if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                differing += sets[x] != sets[y]
                a, b = sorted((find(ids[x]), find(ids[y])))
                root[b] = a
    assert differing > 60
    rows = [(i, t, "en", "s", 1) for i, t in zip(ids, texts)] + [(None, texts[0], "en", "s", 1)] * 2 + [(ids[0], texts[0], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [x.doc_id for x in C.near_duplicates(spark, docs, "").collect()]
    assert got.count(None) == 2 and sorted(x for x in got if x is not None) == sorted({find(i) for i in ids})
    assert N.representatives(docs.limit(0)).count() == 0


def test_pivots_lose_no_link(spark, monkeypatch):
    """All pairs of a bucket at once link what pivots and the pairs left link."""
    r = random.Random(7)
    texts = planted(r, lambda: "".join(r.choice("abcdefgh") for _ in range(5)))[:60]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(x.doc_id for x in N.representatives(docs).collect())
    monkeypatch.setattr(N, "STARS", 0)
    assert sorted(x.doc_id for x in N.representatives(docs).collect()) == want


def test_other_texts_of_an_id_stay(spark):
    r = random.Random(11)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(5, a), (5, b), (5, b), (3, b + " end"), (7, a + " end"), (8, c), (8, c), (9, c)]
    got = [(x.doc_id, x.text) for x in N.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == len(set(got)) and {t for _, t in got} >= {c} and (8, c) in got and (9, c) not in got
    for t in (a, b):  # each text, or a near copy of it, is there
        assert any(x in (t, t + " end") for _, x in got)


def test_texts_stay_where_they_are(spark, monkeypatch):
    """Few ids go to the texts whatever Spark guesses of their size; more than SENT meet them in a shuffle, with the same rows left."""
    r = random.Random(12)
    texts = planted(r, lambda: "".join(r.choice("abcdefgh") for _ in range(5)))[:60]
    rows = [*enumerate(texts), (None, texts[0]), (3, texts[3]), (3, texts[9]), (4, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plan = lambda d: d._jdf.queryExecution().sparkPlan().toString()
    plans, sets = [], N.sets
    monkeypatch.setattr(N, "sets", lambda d: plans.append(plan(d)) or sets(d))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = N.representatives(docs)
        left = sorted(got.collect(), key=str)
        assert "SortMergeJoin" not in plans[0] and "BroadcastHashJoin" in plans[0]
        once = plan(got).split("\n")
        assert any("BroadcastHashJoin" in x and "LeftAnti" in x for x in once) and not any("SortMergeJoin" in x and ("LeftAnti" in x or "LeftSemi" in x) for x in once)
        monkeypatch.setattr(N, "SENT", 0)
        assert sorted(N.representatives(docs).collect(), key=str) == left and "SortMergeJoin" in plans[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_overlaps_and_blocks(spark, monkeypatch):
    r = random.Random(3)
    import numpy as np

    found = [np.array(sorted(r.sample(range(300), r.randint(1, 90))), np.uint64) for _ in range(40)]
    got = N.overlaps(found, columns=32)
    assert all(got[i, j] == len(set(found[i].tolist()) & set(found[j].tolist())) for i in range(40) for j in range(40) if i != j)
    texts = planted(r, lambda: "".join(r.choice("abcdefgh") for _ in range(5)))[:80]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(x.doc_id for x in N.representatives(docs).collect())
    monkeypatch.setattr(N, "STARS", 0)
    monkeypatch.setattr(N, "within_groups", lambda live, found, least, f=N.within_groups: f(live, found, least, 4))
    assert sorted(x.doc_id for x in N.representatives(docs).collect()) == want


def test_tries_meet_links(spark):
    """Sets of similarity 0.8 and little more meet in the tries, others don't; a large group of near copies is one."""
    import numpy as np

    r = np.random.default_rng(5)
    draw = lambda n: r.integers(0, 2**64, n, dtype=np.uint64)
    rows, pairs = [], []
    for k in range(400):
        n = int(r.integers(9, 300))
        both, apart = draw(8 * n), draw(2 * n)
        half = int(r.integers(0, len(apart) + 1))
        for i, own in ((2 * k, apart[:half]), (2 * k + 1, apart[half:])):
            rows.append((i, np.concatenate([both, own])))
        pairs.append((2 * k, 2 * k + 1))
    body = draw(200)
    rows += [(10_000 + k, np.concatenate([body, draw(int(r.integers(0, 9)))])) for k in range(300)]
    data = spark.createDataFrame([(i, bytearray(N.simhash(x).tobytes())) for i, x in rows], "id long, bits binary")
    group = {}
    for x in N.met(N.spread(data)).collect():
        group.setdefault(x.key, set()).add(x.id)
    assert all(min(g) == key for key, g in group.items())
    together = {(key, i) for key, g in group.items() for i in g if i < 10_000 and i != key}
    assert together <= set(pairs) and len(together) >= 398
    assert {i for key, g in group.items() if key >= 10_000 for i in g} == set(range(10_000, 10_300))


def test_walk_by_bit_and_equal_words():
    import numpy as np

    from strandworks.llm.simhash import walk

    r = np.random.default_rng(6)
    heads = r.integers(0, 2**64, 60, dtype=np.uint64)
    fp = np.sort(np.concatenate([heads, heads, heads ^ np.uint64(1), heads ^ (np.uint64(1) << r.integers(0, 64, 60, dtype=np.uint64))]))
    more = r.integers(0, 2, len(fp))  # what near() compares beside fp
    near = lambda x, y: (more[x] == more[y]) & (np.bitwise_count(fp[x] ^ fp[y]) <= 2)
    ends = np.array([0]), np.array([len(fp)])
    got = walk(fp, *ends, N.ALLOWED, near=near, labels=np.arange(len(fp)))
    x, y = np.triu_indices(len(fp), 1)
    want = N.merge(np.arange(len(fp)), x[near(x, y)], y[near(x, y)])
    assert len(set(want)) < len(fp) - 60 and np.array_equal(got, want)
    assert len(N.ALLOWED) == 64 and N.ALLOWED[63] == 1 and N.ALLOWED[0] == 15
