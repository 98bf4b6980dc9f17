"""Model bundles: linear heads by version, kept as checked text, joined to the rows that name the version.

A bundle is one row: version, body (JSON) and the SHA-256 of the body. The body holds the training set's
digest, the features' mean and scale, heads (name, coefficients, intercept, supported) and members, which are a
head's prediction and an offset (name, head, offset, supported). Scores are Spark expressions: no Python.

Null or repeated versions, digests that differ, shapes that differ, values that aren't finite and scales that
aren't above zero are refused when a bundle is read. Rows with a null version or no features score null; rows
that name an absent version or have other than the bundle's number of finite features are an error. Heads and
members that aren't supported score null. An empty table has no scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.joins import ContractError, require_unique

HEADS = "heads array<struct<name: string, coef: array<double>, intercept: double, supported: boolean>>"
MEMBERS = "members array<struct<name: string, head: string, offset: double, supported: boolean>>"
BODY = f"dataset string, mean array<double>, scale array<double>, {HEADS}, {MEMBERS}"
#: Bundles up to this many numbers in all are broadcast to the rows; others are joined by a shuffle.
MOST_NUMBERS = 2_000_000


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & ~c.isin(float("inf"), float("-inf"))


def _all(values: Column, test) -> Column:
    return F.coalesce(F.forall(values, lambda v: F.coalesce(test(v), F.lit(False))), F.lit(False))


def faults(b: Column) -> Column:
    """What is wrong with a body, first found; null if nothing is."""
    d = F.size(b["mean"])
    names = F.concat(F.transform(b["heads"], lambda h: h["name"]), F.transform(b["members"], lambda m: m["name"]))
    heads = F.transform(b["heads"], lambda h: h["name"])
    shapes = (d > 0) & (F.size(b["scale"]) == d) & (F.size(b["heads"]) > 0) & b["members"].isNotNull() & _all(b["heads"], lambda h: (F.size(h["coef"]) == d) & h["supported"].isNotNull())
    numbers = _all(b["mean"], finite) & _all(b["scale"], lambda v: finite(v) & (v > 0)) & _all(b["heads"], lambda h: finite(h["intercept"]) & F.forall(h["coef"], finite)) & _all(b["members"], lambda m: finite(m["offset"]))
    named = _all(names, lambda n: n.isNotNull()) & (F.size(F.array_distinct(names)) == F.size(names)) & _all(b["members"], lambda m: F.array_contains(heads, m["head"]) & m["supported"].isNotNull())
    return F.when(b.isNull() | b["dataset"].isNull(), "no body").when(~F.coalesce(shapes, F.lit(False)), "shape").when(~numbers, "numbers").when(~F.coalesce(named, F.lit(False)), "names")


def packed(bundles: DataFrame) -> DataFrame:
    """(version, body, sha256) of a table with a version and the fields of a body."""
    fields = [f.split()[0] for f in ("dataset", "mean", "scale", "heads", "members")]
    return bundles.select(F.col("version").cast("string").alias("version"), F.to_json(F.struct(*fields)).alias("body")).withColumn("sha256", F.sha2("body", 256))


def issues(rows: DataFrame) -> DataFrame:
    """(version, issue) of packed bundles that can't be used."""
    got = rows.withColumn("b", F.from_json("body", BODY))
    why = F.when(F.col("version").isNull(), "no version").when(~F.col("sha256").eqNullSafe(F.sha2("body", 256)), "digest").otherwise(faults(F.col("b")))
    return got.select("version", why.alias("issue")).where("issue IS NOT NULL")


def checked(rows: DataFrame) -> DataFrame:
    """(version, dataset, mean, scale, heads, members) of packed bundles, all of which must be sound."""
    if bad := issues(rows).take(1):
        raise ContractError(f"bundle {bad[0].version!r}: {bad[0].issue}")
    require_unique(rows, ["version"], "bundles")
    return rows.select("version", F.from_json("body", BODY).alias("b")).select("version", "b.*")


def write(bundles: DataFrame, path: str) -> None:
    """Sound bundles to a new folder."""
    rows = packed(bundles)
    checked(rows)
    rows.write.mode("error").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return checked(spark.read.schema("version string, body string, sha256 string").parquet(path))


def score(df: DataFrame, bundles: DataFrame, version: str, features: str) -> DataFrame:
    """Add ``scores``, a map from the names of heads and members of the bundle that a row names to predictions."""
    numbers = bundles.agg(F.sum(F.size("mean") * (F.size("heads") + 2) + F.size("members"))).first()[0] or 0
    side = bundles.select(F.col("version").alias("_v"), F.struct("mean", "scale", "heads", "members").alias("_b"))
    rows = df.join(F.broadcast(side) if numbers <= MOST_NUMBERS else side, F.col(version).cast("string") == F.col("_v"), "left")
    x, b = F.transform(F.col(features), lambda v: v.cast("double")), F.col("_b")
    sound = (F.size(x) == F.size(b["mean"])) & F.forall(x, finite)
    why = F.when(b.isNull(), F.concat(F.lit("no bundle "), F.col(version).cast("string"))).when(~F.coalesce(sound, F.lit(False)), F.lit("features don't fit bundle"))
    scaled = F.zip_with(F.zip_with(x, b["mean"], lambda v, m: v - m), b["scale"], lambda v, s: v / s)
    rows = rows.withColumn("_x", F.when(F.col(version).isNull() | F.col(features).isNull(), None).when(why.isNotNull(), F.raise_error(why).cast("array<double>")).otherwise(scaled))
    raw = F.transform(b["heads"], lambda h: F.struct(h["name"].alias("name"), (h["intercept"] + F.aggregate(F.zip_with(F.col("_x"), h["coef"], lambda v, c: v * c), F.lit(0.0), lambda a, v: a + v)).alias("value"), h["supported"].alias("supported")))
    rows = rows.withColumn("_h", raw)
    value = F.map_from_entries(F.transform("_h", lambda h: F.struct(h["name"], h["value"])))
    of_heads = F.transform("_h", lambda h: F.struct(h["name"].alias("name"), F.when(h["supported"], h["value"]).alias("value")))
    rows = rows.withColumn("_m", value)
    of_members = F.transform(b["members"], lambda m: F.struct(m["name"].alias("name"), F.when(m["supported"], F.element_at(F.col("_m"), m["head"]) + m["offset"]).alias("value")))
    return rows.withColumn("scores", F.when(F.col("_x").isNotNull(), F.map_from_entries(F.concat(of_heads, of_members)))).drop("_v", "_b", "_x", "_h", "_m")
