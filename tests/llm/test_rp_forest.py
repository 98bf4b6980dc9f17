import numpy as np
import pytest

from strandworks.llm import rp_forest as R


def brute(x, min_cos):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    a = u @ u.T >= min_cos
    np.fill_diagonal(a, False)
    return a


@pytest.mark.parametrize("leaf,block", [(16, 24), (64, 1024)])
def test_recall_and_counts(spark, leaf, block):
    r = np.random.default_rng(4)
    base = r.normal(size=(120, 32))
    near = [b + r.normal(size=32) * s for b in base[:40] for s in (0.05, 0.2, 0.35)]
    dense = [base[0] + r.normal(size=32) * 0.05 for _ in range(80)]
    x = np.concatenate([base, near, dense, base[:5], base[:1]]).astype(np.float32)
    rows = [(1000 - i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    got = {g.vec_id: g for g in R.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, tree int"), leaf=leaf, block=block).collect()}
    a = brute(x.astype(np.float64), 0.9)
    want = {1000 - i: int(s) for i, s in enumerate(a.sum(axis=1))}
    assert len(got) == len(rows) and all(got[k].n_links <= want[k] for k in want)
    assert sum(g.n_links for g in got.values()) >= 0.97 * sum(want.values())
    assert got[1000].component_id == min(1000 - i for i in range(len(x)) if a[0, i])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, []), (10, [1.0]), (11, [2.0]), (None, [1.0, 0.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((g.vec_id or -1, g.n_links, g.component_id or -1) for g in R.near_duplicates(df).collect())
    assert got == [(-1, 0, -1), (1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 3, 1), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 0, 9), (10, 1, 10), (11, 1, 10)]
    assert R.near_duplicates(df.limit(0)).count() == 0


def test_doubles_and_trees_by_depth(spark):
    r = np.random.default_rng(7)
    base = r.normal(size=(60, 48))
    x = np.concatenate([base, base[:20] + r.normal(size=(20, 48)) * 0.1])
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = brute(x, 0.9).sum(axis=1)
    got = {g.vec_id: g.n_links for g in R.near_duplicates(df, leaf=8).collect()}
    assert [got[i] for i in range(len(x))] == want.tolist()
    sample = R.unit(r.normal(size=(3000, 32)))
    few, many = (R.Forest(sample, rows) for rows in (3000, 3_000_000))
    assert few.depth < many.depth and len(few.ways) < len(many.ways) <= R.TREES


def test_long_vectors(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(6, 20_000))
    x[3] = x[0] + r.normal(size=20_000) * 0.01
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert {g.vec_id: g.component_id for g in R.near_duplicates(df).collect()} == {0: 0, 1: 1, 2: 2, 3: 0, 4: 4, 5: 5}
