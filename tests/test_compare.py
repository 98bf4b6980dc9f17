"""Neighbours, balls and set comparisons against all pairs in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandworks.operators import compare, neighbours


def sets(seed=1, clustered=True):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(9, 6)) * (10 if clustered else 0)
    a = centres[r.integers(0, 6, 260)] + r.normal(size=(260, 6))
    b = centres[r.integers(3, 9, 310)] + r.normal(size=(310, 6))
    b[40:60] = b[0]  # a vector that many rows share
    a[7] = b[0]
    return a, b


def frame(spark, x, first=0, extra=()):
    rows = [(first + i, [float(v) for v in p], 1.5) for i, p in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "id long, v array<double>, r double").repartition(5)


def all_distances(a, b):
    return np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=-1))


@pytest.mark.parametrize("leaf,clustered", [(16, True), (50, False), (4000, True)])
def test_neighbours_and_balls(spark, leaf, clustered):
    a, b = sets(leaf, clustered)
    odd = [(9001, None, 1.0), (9002, [1.0], 1.0), (None, [0.0] * 6, 1.0)]
    fa, fb = frame(spark, a, extra=odd), frame(spark, b, 1000, odd)
    d = all_distances(a, b)
    got = {r.id: r.near for r in neighbours.nearest(fa, fb, "id", "v", 4, leaf=leaf).collect()}
    assert set(got) == set(range(len(a)))
    for i in range(len(a)):
        want = sorted((d[i, j], 1000 + j) for j in range(len(b)))[:4]
        assert [n.id for n in got[i]] == [w[1] for w in want] and np.allclose([n.d for n in got[i]], [w[0] for w in want], atol=1e-12)
    own = all_distances(b, b)
    np.fill_diagonal(own, np.inf)
    reach = {r.id: r.radius for r in compare.radii(fb, "id", "v", 3, leaf).collect()}
    assert np.allclose([reach[1000 + j] for j in range(len(b))], np.sort(own, axis=1)[:, 2], atol=1e-12)
    inside = {r.id: r.balls for r in neighbours.covered(fa, fb, "id", "v", "r", leaf).collect()}
    assert [inside[i] for i in range(len(a))] == (d <= 1.5).sum(axis=1).tolist()


def test_coverage_and_authenticity(spark):
    a, b = sets(3)
    fa, fb = frame(spark, a), frame(spark, b, 1000)
    da, db, d = all_distances(a, a), all_distances(b, b), all_distances(a, b)
    np.fill_diagonal(da, np.inf)
    np.fill_diagonal(db, np.inf)
    ra, rb = np.sort(da, axis=1)[:, 4], np.sort(db, axis=1)[:, 4]
    got = compare.coverage(fa, fb, "id", "v", 5, leaf=64).first()
    assert got.precision == pytest.approx((d <= rb).any(axis=1).mean()) and got.recall == pytest.approx((d.T <= ra).any(axis=1).mean())
    near = d.argmin(axis=1)
    assert compare.authenticity(fa, fb, "id", "v", leaf=64).first()[0] == pytest.approx((d.min(axis=1) > db.min(axis=1)[near]).mean())


def test_few_and_no_rows(spark):
    one = frame(spark, np.zeros((1, 2)))
    assert compare.radii(one, "id", "v", 1).count() == 0 and [r.near for r in neighbours.nearest(one, one, "id", "v", 3).collect()] == [[(0.0, 0)]]
    assert neighbours.nearest(one, one.limit(0), "id", "v", 3).count() == 0 and neighbours.covered(one.limit(0), one, "id", "v", "r").count() == 0
    got = neighbours.nearest(frame(spark, np.arange(6.0).reshape(3, 2)), frame(spark, np.ones((2, 2))), "id", "v", 5).collect()
    assert all([n.id for n in r.near] == [0, 1] for r in got)


def test_kernel_entropy(spark):
    r = np.random.default_rng(2)
    x = np.repeat(r.normal(size=(4, 5)) * 50, 30, axis=0)
    df = frame(spark, x)
    assert compare.kernel_entropy(df, "v", 5, 1.0, 128) == pytest.approx(4, abs=0.3) and compare.kernel_entropy(df, "v", 5, 1.0, 128, order=1) == pytest.approx(4, abs=0.3)
    y = r.normal(size=(60, 5))
    w = compare.fourier_weights(5, 32, 1.3, 42)
    f = np.concatenate([np.cos(y @ w), np.sin(y @ w)], axis=1)
    e = np.linalg.eigvalsh(f @ f.T / (60 * 32))
    assert compare.kernel_entropy(frame(spark, y), "v", 5, 1.3, 32) == pytest.approx(1 / (e**2).sum())
    with pytest.raises(ValueError):
        compare.kernel_entropy(df, "v", 9, 1.0, 8)


def test_divergence_diversity_and_conformity(spark):
    df = spark.createDataFrame([(i, float(i % 3), "ab" * (i % 4)) for i in range(12)], "id long, x double, t string")
    ref = spark.createDataFrame([(i, float(i % 2), "ab") for i in range(8)] + [(99, None, None)], "id long, x double, t string")
    p, q = np.array([5, 5, 5]) / 15, np.array([5, 5, 1]) / 11
    assert compare.histogram_kl(df, ref, F.col("x")).first()[0] == pytest.approx((p * np.log(p / q)).sum())
    assert compare.histogram_kl(df, df, F.col("x")).first()[0] == pytest.approx(0)
    assert compare.diversity(ref, "id", "t").first()[0] == 0 and compare.diversity(ref.limit(1), "id", "t").first()[0] is None
    assert 0.3 < compare.diversity(df, "id", "t").first()[0] < 1
    r = np.random.default_rng(5)
    base = spark.createDataFrame([(i, float(v)) for i, v in enumerate(r.normal(size=800))], "id long, x double")
    like = spark.createDataFrame([(i, float(v)) for i, v in enumerate(r.normal(size=400))], "id long, x double")
    off = spark.createDataFrame([(i, float(v) + 9) for i, v in enumerate(r.normal(size=400))], "id long, x double")
    score = lambda d: compare.conformity(d, base, "id", ["x"], 0.1, 0.3).first()[0]
    assert abs(score(like) - 0.5) < 0.06 and score(off) < 0.01


def test_copies_of_a_row_do_not_grow_with_the_table(spark, monkeypatch):
    """Leaves grow with the table once it has many, and vectors of floats travel as floats."""
    monkeypatch.setattr(neighbours, "LEAF", 16)
    x = np.random.default_rng(3).normal(size=(1000, 4))
    df = frame(spark, x).withColumn("v", F.col("v").cast("array<float>"))
    index = neighbours.Index(df, "id", "v", leaf=16)
    assert len(index.stats) <= 2 * neighbours.FEW and dict(index.rows.dtypes)["x"] == "array<float>"


@pytest.mark.parametrize("kind", ["numbers", "grid", "equal", "small", "large"])
def test_tiles_give_what_all_distances_give(kind):
    """First neighbours and balls from single-precision tables, borders and ties included, over more than one tile each way."""
    r = np.random.default_rng(5)
    draw = {"grid": lambda n: r.integers(0, 4, (n, 3)).astype(float), "equal": lambda n: np.ones((n, 2))}.get(kind, lambda n: r.normal(size=(n, 6)) * {"small": 1e-15, "large": 1e20}.get(kind, 1.0))
    x = draw(300)
    y = np.concatenate([draw(2500), x])
    d = np.array([neighbours.exact(y, row) for row in x])
    radius = np.resize(np.sort(d, axis=1)[:, 5], len(y))
    assert (neighbours.balls_around(x, y, radius) == (d <= radius).sum(axis=1)).all()
    own = np.arange(300), np.arange(300) + 2500
    d[own] = np.inf
    want = np.argsort(d, axis=1, kind="stable")[:, :5]
    for bound in (np.full(300, np.inf), np.take_along_axis(d, want, 1)[:, 4]):
        i, j, got = neighbours.first_neighbours(x, y, 5, bound, own)
        assert (i == np.repeat(np.arange(300), 5)).all() and (j.reshape(300, 5) == want).all() and (got.reshape(300, 5) == np.take_along_axis(d, want, 1)).all()


def test_coverage_works_out_the_radii_once(spark, monkeypatch):
    """The index of the balls reads them three times; behind them stand all pairs."""
    made, whole = spark.sparkContext.accumulator(0), compare.radii

    def counted(*args):
        def run(batches):
            for b in batches:
                made.add(b.num_rows)
                yield b

        df = whole(*args)
        return df.mapInArrow(run, df.schema)

    monkeypatch.setattr(compare, "radii", counted)
    r = np.random.default_rng(6)
    got = compare.coverage(frame(spark, r.normal(size=(40, 3))), frame(spark, r.normal(size=(50, 3))), "id", "v").first()
    assert 0 <= got.precision <= 1 and made.value == 90
