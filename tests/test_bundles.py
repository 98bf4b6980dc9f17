"""Bundles: round trip, each refusal, scores against numpy."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandworks.operators.joins import ContractError
from strandworks.sources import bundles

SCHEMA = f"version string, {bundles.BODY}"
RNG = np.random.default_rng(5)


def bundle(version="a", d=6, **changes):
    body = {
        "dataset": "0" * 64,
        "mean": RNG.normal(size=d).tolist(),
        "scale": RNG.uniform(0.5, 2, d).tolist(),
        "heads": [("h1", RNG.normal(size=d).tolist(), 0.25, True), ("h2", RNG.normal(size=d).tolist(), 1 / 3, False)],
        "members": [("m1", "h1", 0.5, True), ("m2", "h2", -1.5, True), ("m3", "h1", 1.0, False)],
    } | changes
    return (version, *body.values())


def rows(spark, *got):
    return spark.createDataFrame(list(got), SCHEMA)


def test_round_trip_and_scores(spark, tmp_path):
    a, b = bundle("a"), bundle("b", d=3)
    bundles.write(rows(spark, a, b), str(tmp_path / "bundles"))
    back = bundles.read(spark, str(tmp_path / "bundles"))
    assert {r.version: (r.mean, r.scale) for r in back.collect()} == {x[0]: (x[2], x[3]) for x in (a, b)}
    x = {1: ("a", RNG.normal(size=6).tolist()), 2: ("b", RNG.normal(size=3).tolist()), 3: (None, [1.0]), 4: ("a", None)}
    df = spark.createDataFrame([(k, *v, "mine") for k, v in x.items()], "id long, version string, x array<double>, heads string")
    got = {r.id: r.scores for r in bundles.score(df, back, "version", "x").collect()}
    assert got[3] is None and got[4] is None
    for k, of in ((1, a), (2, b)):
        z = (np.array(x[k][1]) - of[2]) / of[3]
        h1, h2 = (z @ np.array(h[1]) + h[2] for h in of[4])
        assert got[k]["h2"] is None and got[k]["m3"] is None  # not supported
        assert np.allclose([got[k]["h1"], got[k]["m1"], got[k]["m2"]], [h1, h1 + 0.5, h2 - 1.5], atol=1e-12)


def test_shuffled_when_too_large(spark, monkeypatch):
    monkeypatch.setattr(bundles, "MOST_NUMBERS", 0)
    df = spark.createDataFrame([("a", [0.0] * 6)], "version string, x array<double>")
    assert bundles.score(df, bundles.checked(bundles.packed(rows(spark, bundle()))), "version", "x").count() == 1


BAD = {
    "shape": [{"scale": [1.0]}, {"mean": [], "scale": []}, {"heads": []}, {"heads": [("h", [1.0], 0.0, True)]}, {"heads": [("h", [1.0] * 6, 0.0, None)]}, {"members": None}, {"mean": None}],
    "numbers": [{"mean": [float("nan")] * 6}, {"scale": [0.0] * 6}, {"scale": [float("inf")] * 6}, {"heads": [("h1", [None] * 6, 0.0, True)], "members": []}, {"members": [("m", "h1", float("nan"), True)]}],
    "names": [{"members": [("m", "absent", 0.0, True)]}, {"members": [("h1", "h1", 0.0, True)]}, {"members": [(None, "h1", 0.0, True)]}],
    "no body": [{"dataset": None}],
}


@pytest.mark.parametrize("issue, changes", [(k, c) for k, v in BAD.items() for c in v], ids=str)
def test_unsound_bundles_are_refused(spark, issue, changes):
    packed = bundles.packed(rows(spark, bundle(), bundle("bad", **changes)))
    assert [tuple(r) for r in bundles.issues(packed).collect()] == [("bad", issue)]
    with pytest.raises(ContractError):
        bundles.checked(packed)


def test_digests_versions_and_rows(spark):
    packed = bundles.packed(rows(spark, bundle()))
    changed = packed.withColumn("body", F.replace("body", F.lit("0.25"), F.lit("0.26")))
    assert bundles.issues(changed).first().issue == "digest"
    with pytest.raises(ContractError):
        bundles.checked(packed.union(packed))
    assert bundles.issues(bundles.packed(rows(spark, bundle(None)))).first().issue == "no version"
    sound = bundles.checked(packed)
    for version, x in (("other", [0.0] * 6), ("a", [0.0] * 5), ("a", [float("nan")] * 6), ("a", [None] * 6)):
        with pytest.raises(PySparkException):
            bundles.score(spark.createDataFrame([(version, x)], "version string, x array<double>"), sound, "version", "x").collect()
    empty = spark.createDataFrame([], "version string, x array<double>")
    assert bundles.score(empty, sound, "version", "x").count() == 0
