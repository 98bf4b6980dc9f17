"""Interval regressors against plain numpy fits and numeric derivatives."""

import math

import numpy as np
import pytest

from strandworks.operators import regress as R


def plain_fit(x, low, high, weight, alpha, steps, start, rate=R.RATE):
    """The hinge fit over all rows at once."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    z = np.column_stack([(x - mean) / np.where(scale > 0, scale, 1), np.ones(len(x))])
    d = x.shape[1]
    w = np.zeros(d + 1)
    w[-1] = start
    m = v = np.zeros(d + 1)
    weight = weight / weight.sum()
    for t in range(1, steps + 1):
        p = z @ w
        g = z.T @ (weight * 2 * (np.maximum(p - high, 0) - np.maximum(low - p, 0)))
        g[:-1] += 2 * alpha * w[:-1] / d
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def rows_of(seed=4, n=300):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3)) * [1, 5, 0.1] + [0, 7, 1]
    y = 2 * x[:, 0] - 0.3 * x[:, 1] + 4 + r.normal(size=n) * 0.2
    kind = r.integers(0, 4, n)
    low, high = np.where(kind == 1, -np.inf, np.where(kind == 3, y - 0.5, y)), np.where(kind == 2, np.inf, np.where(kind == 3, y + 0.5, y))
    return x, y, low, high, r.integers(0, 40, n)


def frame(spark, x, low, high, group):
    lift = lambda v: None if math.isinf(v) else float(v)
    rows = [(*map(float, a), lift(b), lift(c), f"g{g}", "h1" if g % 2 else "h2") for a, b, c, g in zip(x, low, high, group)]
    return spark.createDataFrame(rows, "a double, b double, c double, low double, high double, grp string, head string").repartition(5)


def test_hinge_fit_matches_a_plain_one(spark):
    x, _, low, high, group = rows_of()
    sizes = np.bincount(group)
    start = float(np.median(np.where(np.isfinite(low), low, high)))
    want = plain_fit(x, low, high, 1 / sizes[group], 0.05, 25, start)
    fit = R.fit_intervals(frame(spark, x, low, high, group), ["a", "b", "c"], "low", "high", "grp", alpha=0.05, steps=25)
    assert np.allclose([*fit.coefficients[""], fit.intercept[""]], want, rtol=1e-9, atol=1e-12)
    assert len(fit.losses) == 25 and fit.losses[-1] < fit.losses[0]


def test_derivatives_of_the_normal_loss():
    r = np.random.default_rng(1)
    mean, scale = r.normal(size=200) * 3, r.uniform(0.1, 3, 200)
    low = r.normal(size=200) * 3
    high = low + r.uniform(0.1, 4, 200)
    low[:60], high[40:100] = -np.inf, np.inf
    low[40:60], high[150:] = 0.5, low[150:]
    loss, by_mean, by_scale = R.normal_loss(mean, scale, low, high)
    e = 1e-6
    assert np.allclose(by_mean, (R.normal_loss(mean + e, scale, low, high)[0] - R.normal_loss(mean - e, scale, low, high)[0]) / (2 * e), rtol=1e-5, atol=1e-6)
    assert np.allclose(by_scale, (R.normal_loss(mean, scale + e, low, high)[0] - R.normal_loss(mean, scale - e, low, high)[0]) / (2 * e), rtol=1e-4, atol=1e-5)
    far = R.normal_loss(np.array([0.0, 0.0, 0.0]), np.ones(3), np.array([60.0, -61.0, 30.0]), np.array([61.0, -60.0, np.inf]))
    assert all(np.isfinite(f).all() for f in far) and abs(far[0][0] - far[0][1]) < 1e-9 and 450 < far[0][2] < 460
    z = np.array([-19.99, -20.01, -5.0, 0.0, 3.0])
    assert np.allclose(R.log_cdf(z)[:2], R.log_cdf(np.array([-20.0, -20.0])), atol=0.3) and abs(R.log_cdf(z)[3] + math.log(2)) < 1e-12


def test_normal_fit_by_head_recovers_what_made_the_rows(spark):
    x, y, low, high, group = rows_of(n=900)
    y2 = np.where(group % 2 == 1, y, -y)
    shift = y2 - y
    swap = group % 2 == 0
    low2, high2 = np.where(swap, -high, low), np.where(swap, -low, high)
    assert np.isfinite(shift).all()
    df = frame(spark, x, low2, high2, group)
    fit = R.fit_intervals(df, ["a", "b", "c"], "low", "high", head="head", loss="normal", alpha=0.0, steps=120, rate=0.1)
    got = R.predict(df, fit, "head", deviation="sd").select("predicted", "sd", "head", "a", "b").toPandas()
    want = np.where(got["head"] == "h1", 1, -1) * (2 * got["a"] - 0.3 * got["b"] + 4)
    assert np.abs(got["predicted"] - want).mean() < 0.12 and 0.05 < got["sd"].median() < 1
    assert set(fit.coefficients) == {"h1", "h2"} and R.predict(df.limit(1).selectExpr("a", "b", "c", "'other' AS head"), fit, "head").first().predicted is None


def test_errors(spark):
    good = frame(spark, *(v[:6] for i, v in enumerate(rows_of()) if i != 1))
    fit = lambda df, **k: R.fit_intervals(df, ["a", "b"], "low", "high", steps=1, **k)
    fit(good)
    for bad in ("b / 0 * 0", "CAST(NULL AS double)", "double('inf')"):
        with pytest.raises(Exception, match="features|by zero|DIVIDE"):
            fit(good.selectExpr("a", f"{bad} AS b", "low", "high"))
    for low, high, text in (("CAST(NULL AS double)", "CAST(NULL AS double)", "without a bound"), ("2D", "1D", "inverted"), ("double('-inf')", "1D", "not finite")):
        with pytest.raises(ValueError, match=text):
            fit(good.selectExpr("a", "b", f"{low} AS low", f"{high} AS high"))
    for k in ({"loss": "other"}, {"alpha": -1.0}):
        with pytest.raises(ValueError):
            fit(good, **k)
    with pytest.raises(ValueError, match="no rows"):
        fit(good.limit(0))
    with pytest.raises(ValueError, match="both sides"):
        R.require_apart(good, good, "grp")
    R.require_apart(good.where("grp < 'a'"), good, "grp")


def test_exact_median(spark):
    for values in ([3.0], [1.0, 2.0], [5.0, 1.0, 1.0, 9.0], [2.0] * 7, [None, 4.0, 8.0]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        assert R.median(df, "v") == float(np.median([v for v in values if v is not None]))


def test_steps_read_numbers_only(spark):
    x, _, low, high, group = rows_of()
    rows, _, _, heads = R._prepared(frame(spark, x, low, high, group), ["a", "b", "c"], "low", "high", "grp", "head")
    assert heads == ["h1", "h2"] and [k for _, k in rows.dtypes] == ["int"] + ["double"] * 6
    with pytest.raises(ValueError, match="without a head"):
        R.fit_intervals(frame(spark, x, low, high, group).selectExpr("a", "low", "high", "nullif(head, 'h1') AS head"), ["a"], "low", "high", head="head", steps=1)


def test_columns_give_what_the_plain_loss_gives(spark):
    """Gradient and loss of one step by head, of squared distances."""
    x, _, low, high, group = rows_of()
    rows, _, _, _ = R._prepared(frame(spark, x, low, high, group), ["a", "b", "c"], "low", "high", "grp", "head")
    table, now, want = rows.toPandas(), np.random.default_rng(2).normal(size=(2, 4)), np.zeros(9)
    for h in range(2):
        own = table[table["head"] == h]
        z = np.column_stack([own[["x0", "x1", "x2"]], np.ones(len(own))])
        each, by = R.hinge_loss(z @ now[h], own.low.to_numpy(), own.high.to_numpy())
        want[4 * h : 4 * h + 4] = z.T @ (own.weight * by)
        want[-1] += (own.weight * each).sum()
    summed = R._in_columns(rows, now, 3)
    assert "MapInArrow" not in summed._jdf.queryExecution().toString()
    got = {r.i: r.s for r in summed.groupBy("i").sum("s").toDF("i", "s").collect()}
    assert np.allclose([got[i] for i in range(9)], want, rtol=1e-9)
