"""Batched alignments against recursion over all alignments of a pair."""

from functools import lru_cache

import numpy as np
from pyspark.sql import functions as F

from strandworks.functions import align, kernels
from strandworks.operators import joins


def every(a, b, score, opening, extension):
    """The best (score, equal letters, -columns) over all alignments."""

    @lru_cache(maxsize=None)
    def best(i, j, state):
        if i == len(a) and j == len(b):
            return (0, 0, 0)
        out = []
        if i < len(a) and j < len(b):
            s, e, c = best(i + 1, j + 1, 0)
            out.append((s + score(a[i], b[j]), e + (a[i] == b[j]), c - 1))
        if i < len(a):
            s, e, c = best(i + 1, j, 1)
            out.append((s - (extension if state == 1 else opening), e, c - 1))
        if j < len(b):
            s, e, c = best(i, j + 1, 2)
            out.append((s - (extension if state == 2 else opening), e, c - 1))
        return max(out)

    return best(0, 0, 0)


def words(r, n, letters, most):
    return ["".join(r.choice(list(letters), r.integers(0, most + 1))) for _ in range(n)]


def test_global_alignments_match_recursion():
    r = np.random.default_rng(2)
    a, b = words(r, 250, "ACW", 9), words(r, 250, "ACWé", 9)
    for score, opening, extension, plain in (
        (align.points, 5, 1, lambda x, y: align.blosum45()[align.LETTERS.find(x), align.LETTERS.find(y)]),
        (align.equal_or_not(2, -1), 2, 0.5, lambda x, y: 2 if x == y else -1),
        (align.equal_or_not(1, -1), 1, 1, lambda x, y: 1 if x == y else -1),
    ):
        same, columns = align.global_alignments(a, b, score, opening, extension)
        for k in range(len(a)):
            want = every(a[k], b[k], plain, opening, extension)
            assert (same[k], -columns[k]) == want[1:], (a[k], b[k], want)


def test_table():
    t = align.blosum45()
    assert t.shape == (21, 21) and (t == t.T).all() and np.diag(t).tolist() == [5, 7, 6, 7, 12, 6, 6, 7, 10, 5, 5, 5, 6, 8, 9, 4, 5, 15, 8, 5, -1]


def test_local_scores_match_one_by_one():
    r = np.random.default_rng(3)
    a, b = words(r, 400, "ACDE", 14), words(r, 400, "ACD", 20)
    assert align.local_scores(a, b).tolist() == [kernels.local_score(x, y) for x, y in zip(a, b)]


def test_long_and_many():
    r = np.random.default_rng(4)
    long = "".join(r.choice(list(align.LETTERS), 3000))
    same, columns = align.global_alignments([long, "", "A"], [long, long[:5], "A"], align.points, 5, 1)
    assert same.tolist() == [3000, 0, 1] and columns.tolist() == [3000, 5, 1]
    assert align.homologies(["ACDEFGHIKL", "ACDEFGHIKL", "", "A"], ["ACDEFGHIKV", "ACDE", "", "A"]).tolist() == [True, False, False, True]
    assert align.identities(["", "AC"], ["", "AC"]).tolist() == [1.0, 1.0]


def test_columns(spark):
    df = spark.createDataFrame([("ACDE", "ACE"), ("ACE", "ACDE"), (None, "A"), ("A", None), ("", "")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = [tuple(r) for r in df.select(align.global_identity(a, b), align.homology(a, b), align.local_score(a, b)).collect()]
    assert got[0] == got[1] and got[2:4] == [(None, None, None)] * 2 and got[4] == (1.0, False, 0) and got[0][2] == 2


def test_edges_are_all_pairs_above_the_threshold(spark):
    r = np.random.default_rng(5)
    base = words(r, 12, align.LETTERS, 25)
    texts = [w for w in base if w]
    for w in base[:]:
        for _ in range(3):
            v = list(w)
            for _ in range(r.integers(1, 5)):
                if v:
                    v[r.integers(len(v))] = r.choice(list("ACDE") + [""])
            texts.append("".join(v))
    texts = sorted({t for t in texts if t})
    df = spark.createDataFrame(list(enumerate(texts)), "id int, s string")
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    one, two = [texts[min(p)] for p in pairs], [texts[max(p)] for p in pairs]
    for least in (0.55, 0.8):
        want = {(j, i) for (i, j), v in zip(pairs, align.identities(one, two)) if v >= least}
        assert {(g.id_a, g.id_b) for g in joins.aligned_pairs(df, "s", "id", least).collect()} == want and want
    want = {(j, i) for (i, j), v in zip(pairs, align.homologies(one, two)) if v}
    assert {(g.id_a, g.id_b) for g in joins.aligned_pairs(df, "s", "id", homologous=True).collect()} == want and want
