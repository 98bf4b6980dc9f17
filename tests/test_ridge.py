"""Ridge heads over folds against plain fits of each training set."""

import numpy as np
import pytest

from strandworks.operators import ridge as R


def rows(seed=2, n=400):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 4)) * [1, 9, 0.1, 0] + [0, 3, 1, 5]  # the last feature is constant
    head, fold = r.integers(0, 3, n), r.integers(0, 4, n)
    y = x @ [1, -0.5, 3, 0] + head * x[:, 0] + r.normal(size=n)
    y[head == 2] *= -1
    return x, y, head, fold


def plain(x, y, penalty):
    m, s = x.mean(axis=0), x.std(axis=0)
    z = (x - m) / np.where(s > 0, s, 1)
    w = np.linalg.solve(z.T @ z + penalty * np.eye(z.shape[1]), z.T @ (y - y.mean())) / np.where(s > 0, s, 1)
    return w, y.mean() - w @ m


def frame(spark, x, y, head, fold):
    data = [(i, *map(float, a), float(b), f"h{h}", int(f)) for i, (a, b, h, f) in enumerate(zip(x, y, head, fold))]
    data += [(9000, None, 1.0, 1.0, 1.0, 1.0, "h0", 0), (9001, 1.0, 1.0, 1.0, 1.0, None, "h0", 0), (9002, 1.0, 1.0, 1.0, 1.0, 1.0, None, 1)]
    return spark.createDataFrame(data, "id long, a double, b double, c double, d double, y double, head string, fold int").repartition(5)


def test_moments_give_the_fit_of_each_training_set(spark):
    x, y, head, fold = rows()
    m = R.fold_moments(frame(spark, x, y, head, fold), list("abcd"), "y", "fold", "head")
    for out in ({0}, {1, 3}):
        for h, moments in R.without(m, out).items():
            own = (head == int(h[1])) & ~np.isin(fold, list(out))
            for penalty in (0.5, 40.0):
                w, c = plain(x[own], y[own], penalty)
                assert np.allclose(R.solve(moments, penalty), [*w, c], atol=1e-8)


def test_nested_selection(spark):
    x, y, head, fold = rows(3)
    df, penalties = frame(spark, x, y, head, fold), [0.1, 50.0, 5000.0]
    report, predicted = R.nested_ridge(df, "id", list("abcd"), "y", "fold", "head", penalties)

    def error(train, test, p):
        out = []
        for h in range(3):
            w, c = plain(x[train & (head == h)], y[train & (head == h)], p)
            t = test & (head == h)
            out.append(np.abs(y[t] - x[t] @ w - c).mean())
        return np.mean(out)

    got = {r.outer: (r.penalty, r.macro_mae) for r in report.collect()}
    for o in range(4):
        means = [np.mean([error((fold != o) & (fold != i), fold == i, p) for i in range(4) if i != o]) for p in penalties]
        best = penalties[int(np.argmin(means))]
        assert got[o][0] == best and got[o][1] == pytest.approx(error(fold != o, fold == o, best))
    assert predicted.count() == len(y) and predicted.select("id").distinct().count() == len(y)
    with pytest.raises(ValueError, match="three folds"):
        R.nested_ridge(df.where("fold < 2"), "id", ["a"], "y", "fold", "head", [1.0])
