"""Mini-batch k-means: planted groups, nearest centres, the best start, equal fits of equal tables."""

import numpy as np
import pytest

from strandworks.operators import minibatch

RNG = np.random.default_rng(2)
MIDDLES = np.array([[0, 0, 9], [9, 0, 0], [0, 9, 0], [9, 9, 9]], float)
GROUP = RNG.integers(4, size=240)
X = MIDDLES[GROUP] + RNG.normal(scale=0.4, size=(240, 3))


@pytest.fixture(scope="module")
def table(spark):
    bad = [(900, None), (901, [1.0, 2.0]), (902, [1.0, None, 2.0]), (903, [float("nan")] * 3), (904, [float("inf")] * 3)]
    return spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(X)] + bad, "id long, x array<double>").repartition(3).cache()


def test_planted_groups(table):
    got = minibatch.fit(table, "id", "x", 4, starts=6, steps=4, batch=100)
    labels = {r.id: r.cluster for r in minibatch.predict(table, "x", got).collect()}
    assert all(labels[k] is None for k in range(900, 905))
    own = np.array([labels[k] for k in range(240)])
    far = ((X[:, None] - got.centres[None]) ** 2).sum(axis=2)
    assert (far.argmin(axis=1) == own).all()
    assert got.inertia[got.start] == min(got.inertia) and got.inertia[got.start] == pytest.approx(far.min(axis=1).sum())
    assert len({(a, b) for a, b in zip(GROUP, own)}) == 4  # each group is a cluster
    # every row was in one batch, so a centre that was near its group from the first is the group's mean or close to it
    assert np.abs(np.sort(got.centres, axis=0) - np.sort(MIDDLES, axis=0)).max() < 0.6


def test_equal_tables_give_equal_fits(table):
    a, b = (minibatch.fit(t, "id", "x", 3, starts=2, steps=3, batch=30) for t in (table, table.repartition(5)))
    assert (a.centres == b.centres).all() and a.start == b.start and np.allclose(a.inertia, b.inertia)


def test_too_few(table):
    with pytest.raises(ValueError):
        minibatch.fit(table.where("id < 3"), "id", "x", 4, starts=1, steps=1)
    with pytest.raises(ValueError):
        minibatch.fit(table.where("id < 0"), "id", "x", 1, starts=1, steps=1)
