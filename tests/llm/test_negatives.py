import math
import random

import numpy as np
import pytest

from strandworks.llm import negatives as N


def brute(rows, anchors, positives, depth):
    good = {}
    for i, e, label in rows:
        if i is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            good.setdefault((i, label, tuple(math.floor(256 * x) for x in e)))
    out = []
    for a, la, va in good:
        if a % anchors:
            continue
        score = [(-sum(x * y for x, y in zip(va, vb)), b, lb) for b, lb, vb in good if b != a and len(va) == len(vb)]
        for p, pid, _ in sorted(x for x in score if x[2] == la)[:positives]:
            near = [x for x in sorted(score, key=lambda x: x[:2]) if x[2] != la and -80 * p <= -100 * x[0] <= -100 * p][:depth]
            out += [(a, pid, k + 1, n, -p, -s) for k, (s, n, _) in enumerate(near)]
    return sorted(out)


def clustered(r, n, d, spread):
    centres = [[r.gauss(0, 1) for _ in range(d)] for _ in range(4)]
    return [(i, [float(np.float32(x + r.gauss(0, spread))) for x in centres[r.randrange(4)]], r.randrange(3)) for i in range(n)]


@pytest.mark.parametrize("n,d,spread,block,group", [(400, 6, 0.4, 32, 4), (300, 24, 0.9, 64, 8), (250, 2, 0.05, 16, 2)])
def test_matches_brute_force(spark, n, d, spread, block, group):
    rows = clustered(random.Random(n), n, d, spread)
    rows += [(1000 + k, rows[3][1], rows[3][2]) for k in range(90)] + [(2000 + k, rows[4][1], 9) for k in range(5)] + [rows[7], rows[0], rows[10]]
    df = spark.createDataFrame([(*x, 0) for x in rows], "vec_id long, embedding array<float>, label int, `group` int").repartition(5)
    got = sorted(tuple(g) for g in N.hard_negatives(df, anchors=10, block=block, group=group).collect())
    want = brute(rows, 10, 5, 5)
    assert got == want and len(want) > 100


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (100, [1.0, 0.25], 1), (1, [1.0, 0.5], 1), (2, [0.9, 0.5], 2), (3, [0.9, 0.5], None), (4, None, 2), (5, [nan, 1.0], 2), (6, [inf, 1.0], 2), (7, [1.0, None], 2), (8, [], 2), (9, [1.0], 2), (200, [2.0], 2), (300, [], 2), (None, [1.0, 0.5], 2), (400, [-1.0, -1.0], 5), (401, [1.0, 1.0], 5), (402, [-1.0, 2.0], 6), (0, [0.5, 0.5], 1), (2, [0.9, 0.5], 2), (500, [1e12, 1e12], 2), (501, [1e12, 0.0], 2), (502, [1e12, 0.0], 3), (600, [1e30, 1.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(g) for g in N.hard_negatives(df).collect())
    assert got == brute([x for x in rows if x[0] not in (500, 501, 502, 600)], 100, 5, 5)
    large = [(100, [4e6, 3e6, 1.0], 1), (1, [4e6, 3e6, 2.0], 1), (2, [4e6, 3e6, 1.0], 2), (3, [4e6, 2999999.99, 1.0], 2)]  # sums beyond 2**53
    assert sorted(tuple(g) for g in N.hard_negatives(spark.createDataFrame(large, "vec_id long, embedding array<double>, label int")).collect()) == brute(large, 100, 5, 5)
    assert N.hard_negatives(df.limit(0)).count() == 0 and N.hard_negatives(df.where("vec_id % 100 > 0")).count() == 0


def test_whole_groups_of_anchors_are_pruned():
    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 16)) * 300
    x = np.concatenate([c + r.normal(size=(100, 16)) * 20 for c in centres]).astype(np.int64)
    label = np.repeat(np.arange(12) % 3, 100)
    ids = np.arange(len(x))
    b = N.Tree(x, label)
    at = np.arange(0, len(x), 20)
    a = N.Tree(x[at], label[at], N.ANCHOR_LEAF)
    wanted = N.Wanted([[(None, None)] for _ in at], 5)
    scored = N.walk(a, x[at][a.order], ids[at][a.order], b, x[b.order], ids[b.order], wanted, True)
    assert scored < 0.6 * len(at) * len(x) / 3
    for k, i in enumerate(at[a.order]):
        score = x @ x[i]
        want = sorted((-score[j], j) for j in ids if j != i and label[j] == label[i])[:5]
        assert wanted.lists[k][0] == want


def test_intervals_hold_all_products():
    r = np.random.default_rng(6)
    x, y = (r.integers(-300, 300, (n, 5)) for n in (70, 90))
    a, b = (N.Tree(v, r.integers(0, 3, len(v)), 4) for v in (x, y))
    low, high = N.intervals(a, b)
    p = N.products(x[a.order], y[b.order])
    for i, (s, e, *_) in enumerate(a.nodes):
        for j, (t, f, *_) in enumerate(b.nodes):
            assert low[i, j] <= p[s:e, t:f].min() and p[s:e, t:f].max() <= high[i, j]


def test_anchor_bodies_are_never_broadcast(spark, monkeypatch):
    """What visits the leaves holds a body for each group and leaf: it must not be the side of a join that goes through the driver."""
    plans, searched = [], N.searched

    def watched(*args):
        out = searched(*args)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(N, "searched", watched)
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=8).tolist(), int(i % 4)) for i in range(3000)]
    N.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), anchors=500, block=512, group=8).count()
    assert len(plans) == 3
    for plan in plans:
        visits = [line for line in plan.splitlines() if "Join [width" in line]
        assert visits and not any("BuildLeft" in line for line in visits)
