"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs of a word: a vector of the word (a row for each word seen in at least ``MIN_DF`` training texts,
one shared row for the rest) and the mean and maximum of vectors of its hashed byte trigrams. All
overlapping windows of ``WINDOW`` words, ``STRIDE`` apart, of the whole text are scored; a text's score
is that of its highest window, through a logistic scale fitted on the training texts.

Training: at most ``TOXIC_DOCS`` labelled toxic and ``CLEAN_DOCS`` labelled clean documents (those of the
smallest id hashes, of at most ``TRAIN_BYTES`` bytes), from labels whose crc32(doc_id as text) mod 3 is
not 1. The label is the document's, so in each epoch a toxic text trains on the window that scores
highest and a clean one on its highest and a random one. The first coordinates of the vectors start as
log odds of the training texts. Gradients are written out by hand and applied by Adam.

Rows: null and wordless texts score the empty window; repeated rows each get the same score; a null id
is not held out and never trains; several labels of one document count as toxic if one is, and of several
texts of one id the smallest trains; of windows that tie for highest the first trains; without
labels of both kinds every score is 0 (or 1 if all are toxic). No rows give no rows; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import blocks, carried

TOXIC_DOCS, CLEAN_DOCS, TRAIN_BYTES = 500, 1000, 50_000
WINDOW, STRIDE, HIDDEN, DIM, BUCKETS, WORDS, MIN_DF = 64, 32, 8, 8, 4096, 4096, 3
EPOCHS, STEPS, BATCH, RATE = 5, 60, 256, 0.02
CACHE_WORDS, CACHE_CHARS, SCORE_BATCH = 60_000, 2_000_000, 1024
THRESHOLD = 0.7


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


def bare(word: str) -> str:
    return word.strip(".,;:!?\"'()")


def trigrams(bares: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of all words, marked at both ends, in one array; how many each word has."""
    parts = [b"^" + (w.encode("utf-8") or b"_") + b"$" for w in bares]
    raw = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    if not len(parts):
        return np.zeros(0, np.int64), size
    at = np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size)
    code = (raw[:-2] << np.uint64(16) | raw[1:-1] << np.uint64(8) | raw[2:])[(at < np.repeat(size, size) - 2)[:-2]]
    return ((code * np.uint64(2654435761) >> np.uint64(12)) % np.uint64(BUCKETS)).astype(np.int64), size - 2


def windows(n: int) -> list[tuple[int, int]]:
    """Spans of all windows over n words; one empty span for none."""
    return [(a, min(n, a + WINDOW)) for a in range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)]


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Net:
    """Parameters, forward pass and gradients."""

    def __init__(self, vocab: dict[str, int], word_odds: np.ndarray, gram_odds: np.ndarray, seed: int = 7):
        r = np.random.default_rng(seed)
        h, d = HIDDEN, DIM
        f = lambda *s, scale=0.15: (r.normal(size=s) * scale).astype(np.float32)
        self.vocab = vocab
        self.p = {"word": f(len(vocab) + 1, d), "gram": f(BUCKETS, d), "wx": f(3 * d, 6 * h, scale=0.3), "bx": np.zeros(6 * h, np.float32), "uf": f(h, 3 * h, scale=0.3), "ub": f(h, 3 * h, scale=0.3), "att": f(2 * h, h, scale=0.5), "va": f(h, scale=0.5), "out": f(2 * h, scale=0.5), "b0": np.zeros(1, np.float32)}
        self.p["word"][:-1, 0], self.p["gram"][:, 0] = word_odds, gram_odds
        self.scale = (1.0, 0.0)

    def lookup(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of words in the word table, their trigrams in one array, and where each word's begin."""
        bares = [bare(w) for w in words]
        grams, n = trigrams(bares)
        rows = np.array([self.vocab.get(w, len(self.vocab)) for w in bares], np.int64)
        return rows, grams, np.cumsum(n) - n

    def inputs(self, look) -> tuple[np.ndarray, np.ndarray]:
        rows, grams, starts = look
        g = self.p["gram"][grams]
        n = np.diff(np.append(starts, len(grams)))[:, None]
        x = np.concatenate([self.p["word"][rows], np.add.reduceat(g, starts) / n, np.maximum.reduceat(g, starts)], axis=1) if len(rows) else np.zeros((0, 3 * DIM), np.float32)
        return x, x @ self.p["wx"] + self.p["bx"]

    def logits(self, pre: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Logits of windows, as ``forward`` gives them, in place; ids index rows of ``pre``, -1 is padding at the end."""
        n, t, h = len(ids), ids.shape[1], HIDDEN
        pre = pre if len(pre) else np.zeros((1, 6 * h), np.float32)
        at = np.ascontiguousarray(np.maximum(ids, 0).T)
        mask = np.ascontiguousarray((ids >= 0).T.astype(np.float32))[:, :, None]
        hs = np.zeros((t, n, 2 * h), np.float32)
        zr, c, g, gc = (np.empty((n, w), np.float32) for w in (2 * h, h, 2 * h, h))
        z, r = zr[:, :h], zr[:, h:]
        with np.errstate(over="ignore"):  # exp of a gate that is shut: 1 / inf is 0
            for side, u, steps in ((0, self.p["uf"], range(t)), (1, self.p["ub"], range(t - 1, -1, -1))):
                gates, inner = (np.ascontiguousarray(pre[:, side * 3 * h + a : side * 3 * h + b], np.float32) for a, b in ((0, 2 * h), (2 * h, 3 * h)))
                ug, uc = np.ascontiguousarray(u[:, : 2 * h]), np.ascontiguousarray(u[:, 2 * h :])
                state = np.zeros((n, h), np.float32)
                for k in steps:
                    np.take(gates, at[k], axis=0, out=zr, mode="clip")
                    np.take(inner, at[k], axis=0, out=c, mode="clip")
                    zr += np.matmul(state, ug, out=g)
                    np.negative(zr, out=zr)
                    np.exp(zr, out=zr)
                    zr += 1
                    np.reciprocal(zr, out=zr)
                    c += np.multiply(np.matmul(state, uc, out=gc), r, out=gc)
                    np.tanh(c, out=c)
                    c -= state
                    np.subtract(1, z, out=z)
                    z *= mask[k]
                    c *= z
                    state += c
                    hs[k, :, side * h : (side + 1) * h] = state
        a = hs @ self.p["att"]
        s = np.where(mask[:, :, 0] > 0, np.tanh(a, out=a) @ self.p["va"], -1e9)
        w = np.exp(s - s.max(axis=0)) * mask[:, :, 0]
        w = w / np.maximum(w.sum(axis=0), 1e-9)
        return (w[:, :, None] * (hs @ self.p["out"])[:, :, None]).sum(axis=(0, 2)) + self.p["b0"]

    def forward(self, pre: np.ndarray, ids: np.ndarray):
        """Logits of windows and what ``gradients`` needs; ids index rows of ``pre``, -1 is padding at the end."""
        n, t, h = len(ids), ids.shape[1], HIDDEN
        mask = (ids >= 0).astype(np.float32)
        safe = np.where(ids >= 0, ids, 0) if len(pre) else np.zeros_like(ids)
        pre = pre if len(pre) else np.zeros((1, 6 * h), np.float32)
        hs, tape = np.zeros((t, n, 2 * h), np.float32), []
        for side, u, steps in ((0, self.p["uf"], range(t)), (1, self.p["ub"], range(t - 1, -1, -1))):
            part = np.ascontiguousarray(pre[:, side * 3 * h : (side + 1) * 3 * h])
            state = np.zeros((n, h), np.float32)
            for k in steps:
                m = mask[:, k : k + 1]
                x, g = part[safe[:, k]], state @ u
                zr = _sigmoid(x[:, : 2 * h] + g[:, : 2 * h])
                z, r, gc = zr[:, :h], zr[:, h:], g[:, 2 * h :]
                c = np.tanh(x[:, 2 * h :] + r * gc)
                new = state + m * (1 - z) * (c - state)
                tape.append((side, k, state, z, r, gc, c))
                state = new
                hs[k, :, side * h : (side + 1) * h] = state
        a = np.tanh(hs @ self.p["att"])
        s = np.where(mask.T > 0, a @ self.p["va"], -1e9)
        w = np.exp(s - s.max(axis=0)) * (mask.T > 0)
        w = w / np.maximum(w.sum(axis=0), 1e-9)
        pooled = (w[:, :, None] * hs).sum(axis=0)
        logit = pooled @ self.p["out"] + self.p["b0"]
        return logit, (hs, a, w, pooled, tape, mask)

    def gradients(self, look, ids: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        h = HIDDEN
        x, pre = self.inputs(look)
        logit, (hs, a, w, pooled, tape, mask) = self.forward(pre, ids)
        d = ((_sigmoid(logit) - label) * weight / weight.sum()).astype(np.float32)
        g = {"out": pooled.T @ d, "b0": np.array([d.sum()], np.float32)}
        dpool = d[:, None] * self.p["out"]
        dw = (hs * dpool).sum(axis=2)
        ds = w * (dw - (w * dw).sum(axis=0))
        dhs = w[:, :, None] * dpool
        da = ds[:, :, None] * self.p["va"] * (1 - a * a)
        g["va"] = (a * ds[:, :, None]).sum(axis=(0, 1))
        g["att"] = np.tensordot(hs, da, axes=((0, 1), (0, 1)))
        dhs = dhs + da @ self.p["att"].T
        dpre = np.zeros((max(1, len(pre)), 6 * h), np.float32)
        back = {0: np.zeros((len(ids), h), np.float32), 1: np.zeros((len(ids), h), np.float32)}
        g["uf"], g["ub"] = np.zeros_like(self.p["uf"]), np.zeros_like(self.p["ub"])
        for side, k, state, z, r, gc, c in reversed(tape):
            u, name = (self.p["uf"], "uf") if side == 0 else (self.p["ub"], "ub")
            dn = back[side] + dhs[k, :, side * h : (side + 1) * h]
            m = mask[:, k : k + 1]
            dh, live = (1 - m) * dn, m * dn
            ac = live * (1 - z) * (1 - c * c)
            az = live * (state - c) * z * (1 - z)
            ar = ac * gc * r * (1 - r)
            dg = np.concatenate([az, ar, ac * r], axis=1)
            g[name] += state.T @ dg
            back[side] = dh + live * z + dg @ u.T
            ok = ids[:, k] >= 0
            np.add.at(dpre[:, side * 3 * h : (side + 1) * 3 * h], ids[ok, k], np.concatenate([az, ar, ac], axis=1)[ok])
        dpre = dpre[: len(pre)]
        g["wx"], g["bx"] = x.T @ dpre, dpre.sum(axis=0)
        dx = dpre @ self.p["wx"].T
        rows, grams, starts = look
        n = np.diff(np.append(starts, len(grams)))
        g["word"], g["gram"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["gram"])
        np.add.at(g["word"], rows, dx[:, :DIM])
        of = np.repeat(np.arange(len(rows)), n)
        top = self.p["gram"][grams] == x[of, 2 * DIM :]
        np.add.at(g["gram"], grams, (dx[:, DIM : 2 * DIM] / n[:, None])[of] + top * dx[of, 2 * DIM :])
        return g

    def table(self, words: list[str]) -> np.ndarray:
        return self.inputs(self.lookup(words))[1].astype(np.float32) if words else np.zeros((0, 6 * HIDDEN), np.float32)


def _pad(spans: list[np.ndarray]) -> np.ndarray:
    out = np.full((len(spans), max(1, max(map(len, spans), default=1))), -1, np.int64)
    for i, s in enumerate(spans):
        out[i, : len(s)] = s
    return out


def train(texts: list[str], labels: list[int], seed: int = 7) -> Net | float:
    """A fitted network; a constant score where the labels are all alike."""
    labels = np.array(labels, np.float32)
    if not len(labels) or labels.min() == labels.max():
        return float(labels[0]) if len(labels) else 0.0
    r = np.random.default_rng(seed)
    docs = [tokens(t) for t in texts]
    bares = [{bare(w) for w in d} for d in docs]
    df: dict[str, list[int]] = {}
    grams = np.zeros((2, BUCKETS))
    for words, y in zip(bares, labels.astype(int).tolist()):
        for w in words:
            df.setdefault(w, [0, 0])[y] += 1
        grams[y, np.unique(trigrams(sorted(words))[0])] += 1
    vocab = {w: i for i, w in enumerate(sorted((w for w, c in df.items() if sum(c) >= MIN_DF), key=lambda w: (-sum(df[w]), w))[:WORDS])}
    n = np.array([(labels == 0).sum(), (labels == 1).sum()])

    def odds(c: np.ndarray) -> np.ndarray:
        """Log odds of texts of the two kinds, shrunk where the shares lie within few standard errors."""
        p = (c.sum(axis=0) + 0.5) / (n.sum() + 1)
        z = np.abs(c[1] / n[1] - c[0] / n[0]) / np.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1]))
        raw = np.log((c[1] + 0.5) / (n[1] + 1)) - np.log((c[0] + 0.5) / (n[0] + 1))
        return np.clip(raw, -3, 3) * np.clip((z - 3) / 4, 0, 1)

    net = Net(vocab, odds(np.array([df[w] for w in vocab]).T.reshape(2, -1)), odds(grams), seed)
    del bares, df  # the driver's memory is small
    names: dict[str, int] = {}
    ids = [np.array([names.setdefault(w, len(names)) for w in d], np.int64) for d in docs]
    look = net.lookup(list(names))
    del docs, names
    spans = [(i, a, b) for i, d in enumerate(ids) for a, b in windows(len(d))]
    of = np.array([s[0] for s in spans])
    first = net.inputs(look)[0]
    hint = first[:, [0, 2 * DIM]].max(axis=1) if len(first) else np.zeros(0)
    scores = np.array([hint[ids[i][a:b]].max() if b > a else -9.0 for i, a, b in spans])
    lead = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    mom: dict[str, list[np.ndarray]] = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    picks = len(ids) + int((labels == 0).sum())
    epochs = max(EPOCHS, -(-STEPS // -(-picks // BATCH)))  # small samples take more rounds
    for epoch in range(epochs + 1):
        order = np.lexsort((-scores, of))
        best = order[lead]  # the highest window of each document
        if epoch == epochs:
            break
        ends = np.append(lead[1:], len(of))
        clean = np.flatnonzero(labels == 0)
        pick = np.concatenate([best, lead[clean] + (r.random(len(clean)) * (ends - lead)[clean]).astype(int)])
        y = labels[of[pick]]
        weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
        for part in np.array_split(r.permutation(len(pick)), -(-len(pick) // BATCH)):
            chosen = [ids[i][a:b] for i, a, b in (spans[k] for k in pick[part])]
            used, local = np.unique(np.concatenate(chosen), return_inverse=True)
            cuts = np.cumsum([len(c) for c in chosen])[:-1]
            sub_n = np.diff(np.append(look[2], len(look[1])))[used]
            sub = (look[0][used], np.concatenate([look[1][look[2][w] : look[2][w] + k] for w, k in zip(used, sub_n)] or [np.zeros(0, np.int64)]), np.cumsum(np.append(0, sub_n))[:-1])
            g = net.gradients(sub, _pad(np.split(local, cuts)), y[part], weight[part])
            step += 1
            for k, v in g.items():
                m, s = mom[k]
                m += 0.1 * (v - m)
                s += 0.01 * (v * v - s)
                net.p[k] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
        pre = net.inputs(look)[1]
        scores = np.concatenate([net.logits(pre, _pad([ids[i][a:b] for i, a, b in spans[k : k + SCORE_BATCH]])) for k in range(0, len(spans), SCORE_BATCH)])
    top = scores[best]
    net.scale = _logistic(top, labels)
    return net


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic scale (positive slope), by damped Newton steps on balanced classes."""
    mean, sd = float(x.mean()), float(x.std()) or 1.0
    u = (x - mean) / sd
    w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    t = np.where(y == 1, 1 - 1 / (2 + (y == 1).sum()), 1 / (2 + (y == 0).sum()))
    a = np.array([1.0, 0.0])
    design = np.stack([u, np.ones_like(u)], 1)
    for _ in range(50):
        p = _sigmoid(design @ a)
        grad = design.T @ (w * (p - t)) + 1e-4 * a
        hess = (design * (w * p * (1 - p))[:, None]).T @ design + 1e-4 * np.eye(2)
        a = a - np.clip(np.linalg.solve(hess, grad), -1, 1)
    return max(float(a[0]), 0.05) / sd, float(a[1]) - max(float(a[0]), 0.05) * mean / sd


class Scorer:
    """Scores texts with a bounded table of the inputs of words."""

    def __init__(self, net: Net | float):
        self.net, self.names, self.rows, self.chars = net, {}, np.zeros((0, 6 * HIDDEN), np.float32), 0

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if not isinstance(self.net, Net):
            return np.full(len(texts), float(self.net))
        docs = [tokens(t) for t in texts]
        new = {w for w in set().union(*docs) if w not in self.names}
        if len(self.names) + len(new) > CACHE_WORDS:
            self.names, self.rows, new = {}, self.rows[:0], set().union(*docs)
        fresh = sorted(new)
        self.names.update(zip(fresh, range(len(self.names), len(self.names) + len(fresh))))
        self.rows = np.concatenate([self.rows, self.net.table(fresh)])
        best = np.full(len(texts), -np.inf)
        spans: list[np.ndarray] = []
        of: list[int] = []

        def flush() -> None:
            if spans:
                np.maximum.at(best, of, self.net.logits(self.rows, _pad(spans)))
                spans.clear()
                of.clear()

        for i, d in enumerate(docs):
            ids = np.array([self.names[w] for w in d], np.int64)
            for a, b in windows(len(d)):
                spans.append(ids[a:b])
                of.append(i)
                if len(spans) == SCORE_BATCH:
                    flush()
        flush()
        self.chars += sum(map(len, fresh))
        if len(self.names) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.names, self.rows, self.chars = {}, self.rows[:0], 0
        slope, shift = self.net.scale
        return _sigmoid(best * slope + shift)


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """The bounded training sample, in a fixed order."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = None
    for kind, most in ((1, TOXIC_DOCS), (0, CLEAN_DOCS)):
        part = known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        pick = part if pick is None else pick.union(part)
    short = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= TRAIN_BYTES)
    rows = short.join(F.broadcast(pick), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).collect()  # at most TOXIC_DOCS + CLEAN_DOCS
    rows.sort(key=lambda r: r.doc_id)
    return [r.text for r in rows], [int(r.toxic) for r in rows]


def score(docs: DataFrame, net: Net | float, carry: list[str] | None = None) -> DataFrame:
    """docs -> doc_id, score, row of carried columns."""
    extra, extra_schema = carried(docs, carry)
    more = bool(extra)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for whole in batches:
            for part in blocks(whole):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scorer(part.column("text").to_pylist()).astype(np.float64)), *([part.column("row")] if more else [])], names=["doc_id", "score", *(["row"] if more else [])])

    return docs.select("doc_id", "text", *extra).mapInArrow(run, "doc_id long, score double" + extra_schema)


def fit(docs: DataFrame, labels: DataFrame) -> Net | float:
    return train(*training_rows(docs, labels))
