"""Panels of many metrics, matrix extension, consensus of predictors, adoption of a calibration."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandworks.functions import align
from strandworks.operators import joins, metrics, rank, resample

RNG = np.random.default_rng(3)


def test_panels_equal_numpy(spark):
    rows = [(k, float(RNG.normal()), None if k % 19 == 0 else float(RNG.integers(9)), int(RNG.integers(4))) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c long")
    kinds = {"a_mean": (F.col("a"), "mean"), "a_mid": (F.col("a"), "median"), "c_kinds": (F.col("c"), "distinct"), "b_mean": (F.col("b"), "mean_of_all"), "b_mid": (F.col("b"), "median_of_all"), "flag": (F.col("a") > 0, "mean")}
    panels = resample.panel_metrics(df, "id", kinds, 7, 30, seed=8)
    r, want = np.random.default_rng(8), {}
    for d in range(30):
        own = [rows[i] for i in r.choice(40, 7, replace=False)]
        a, b = [x[1] for x in own], [x[2] for x in own]
        some = None in b
        want[d] = (np.mean(a), np.median(a), len({x[3] for x in own}), None if some else np.mean(b), None if some else np.median(b), np.mean(np.array(a) > 0))
    got = {x.draw: tuple(x)[1:] for x in panels.collect()}
    assert got.keys() == want.keys()
    for d in want:
        assert [v is None for v in got[d]] == [v is None for v in want[d]]
        assert np.allclose([v for v in got[d] if v is not None], [v for v in want[d] if v is not None])
    s = {x.metric: x for x in resample.panel_summary(panels, list(kinds)).collect()}
    assert s.keys() == {"a_mean", "a_mid", "c_kinds", "flag"}  # b is missing in some draw
    means = [w[0] for w in want.values()]
    assert s["a_mean"].n == 30 and np.allclose([s["a_mean"].mean, s["a_mean"].std, s["a_mean"].p05, s["a_mean"].max], [np.mean(means), np.std(means), np.quantile(means, 0.05), max(means)])
    with pytest.raises(ValueError):
        resample.panel_metrics(df, "id", kinds, 41, 3)


def cells(spark, *rows):
    return spark.createDataFrame(list(rows), "id_a long, id_b long, ratio double")


@pytest.mark.parametrize("block", [3, 2048])
def test_matrix_is_extended(spark, block):
    texts = {k: "".join(RNG.choice(list("ACDEFG"), 3 + k % 5)) + "ACDEFGHIKLMN"[k] for k in range(12)}
    df = spark.createDataFrame(list(texts.items()), "id long, s string")
    known = {(1, 5): 0.125, (2, 7): 0.5, (0, 11): 0.75}
    got = joins.extended_matrix(df, cells(spark, *[(b, a, v) for (a, b), v in known.items()], (1, 5, 0.125), (3, 3, 1.0)), "id", "s", block=block).collect()
    pairs = [(a, b) for a in texts for b in texts if a < b]
    fresh = align.identities(*zip(*[sorted((texts[a], texts[b])) for a, b in pairs]))
    assert len(got) == len(pairs) and {(r.id_a, r.id_b): r.ratio for r in got} == pytest.approx(dict(zip(pairs, fresh.tolist())) | known)


def test_unsound_matrices_are_refused(spark):
    df = spark.createDataFrame([(1, "AC"), (2, "AD"), (3, "AE")], "id long, s string")
    for bad in [((1, 2, 0.5), (2, 1, 0.6)), ((1, 2, None),), ((1, 2, float("nan")),), ((1, 2, float("inf")),), ((1, 9, 0.5),), ((1, 1, 0.5),)]:
        with pytest.raises(joins.ContractError):
            joins.extended_matrix(df, cells(spark, *bad), "id", "s")
    with pytest.raises(joins.ContractError):
        joins.extended_matrix(df.withColumn("s", F.lit("A")), cells(spark), "id", "s")
    with pytest.raises(PySparkException):
        joins.extended_matrix(df, cells(spark), "id", "s", measure=lambda a, b: F.lit(1.5)).collect()
    assert joins.extended_matrix(df.limit(0), cells(spark), "id", "s").count() == 0


def test_consensus_of_predictors(spark):
    n = 15
    votes, p = RNG.integers(0, 5, n).astype(float), RNG.normal(size=(2, n, 3))
    df = spark.createDataFrame([(k, float(votes[k]), p[0, k].tolist(), p[1, k].tolist()) for k in range(n)], "id long, v double, p array<double>, q array<double>")
    score = lambda x: np.array([((x < y).sum() + ((x == y).sum() - 1) / 2) / (n - 1) for y in x])
    want = (score(votes) + score(-p[0].mean(1)) + score(-p[1].mean(1))) / 3
    got = {r.id: r.c for r in rank.consensus_rank(df, "v", {"p": 3, "q": 3}, "c").collect()}
    assert np.allclose([got[k] for k in range(n)], want)
    assert rank.consensus_rank(df.limit(1), "v", {"p": 3}, "c").first().c == 1.0
    for bad in (F.array(F.lit(1.0)), F.array(*[F.lit(float("nan"))] * 3), F.lit(None).cast("array<double>")):
        with pytest.raises(PySparkException):
            rank.consensus_rank(df.withColumn("p", bad), "v", {"p": 3}, "c").collect()
    with pytest.raises(ValueError):
        rank.consensus_rank(df, "v", {}, "c")


def test_adoption_rule(spark):
    rows = [(k % 6, k % 6 // 3, 0.5 + (k % 6) / 100, 0.9 if k % 6 > 2 else 0.1, 1 - k % 6 / 5, 0.4 + (k % 6) / 50) for k in range(30)] + [(None, 1, 0.0, 0.0, 0.0, 0.0), (1, None, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "g long, y int, base double, good double, wrong double, mild double")
    got = {r.variant: r for r in metrics.adopted_variant(df, "y", "g", "base", ["mild", "wrong", "good"]).collect()}
    assert [v for v, r in got.items() if r.adopted] == ["good"] and got["good"].brier == pytest.approx(0.01)
    assert got["wrong"].spearman_by_key == pytest.approx(-got["base"].spearman_by_key)
    assert not any(r.adopted for r in metrics.adopted_variant(df, "y", "g", "good", ["mild", "wrong"]).collect())
    assert [r.brier for r in metrics.adopted_variant(df.limit(0), "y", "g", "base", ["mild"]).collect()] == [None, None]


def test_rank_correlation_of_means_summed_in_any_order(spark):
    """The last bits of a mean differ from one evaluation to the next, as they do with the order of a shuffle's blocks."""
    import random

    from pyspark.sql import functions as F

    noise = F.udf(lambda p: p + random.random() * 1e-9, "double").asNondeterministic()
    rows = [("abcd"[k % 4], 0.2 * (k % 4) + 0.01 * (k // 4), int((k // 4) < 2 * (k % 4))) for k in range(40)]
    df = spark.createDataFrame(rows, "g string, p double, y int").withColumn("p", noise("p"))
    assert round(metrics.binary(df, "p", "y", "g").first().spearman_by_key, 6) == 1.0
    got = metrics.adopted_variant(df.withColumnRenamed("p", "base"), "y", "g", "base", []).first()
    assert round(got.spearman_by_key, 6) == 1.0


def test_top_fraction_by_ranges(spark):
    nan = float("nan")
    rows = [("a", float(k // 3), k % 2, k) for k in range(11)] + [("b", 1.0, 1, 5), ("b", 1.0, 0, 4), ("b", None, 0, 1), ("b", nan, 0, 2), ("c", nan, 1, 1), (None, 2.0, 1, 1)]
    df = spark.createDataFrame(rows, "g string, s double, y int, k long")
    got = {r.g: r.top_mean for r in metrics.top_fraction(df, "g", "s", "y", "k", 0.25).collect()}
    a = [y for _, _, y, _ in sorted(rows[:11], key=lambda r: (r[1], r[3]))[:3]]
    assert got == {"a": pytest.approx(np.mean(a)), "b": 0.0, None: 1.0}  # no score: no place; no group is a group
    assert metrics.top_fraction(df.limit(0), "g", "s", "y", "k").count() == 0
