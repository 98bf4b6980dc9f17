"""Contracts of tables and runs: reports of all issues, submissions, identities, repeats, reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import seq
from . import joins
from .joins import ContractError


def record_issues(df: DataFrame, key: str, text: str, order: str, reference: DataFrame, similarity_max: float | None = None, low: int = 8, high: int = 50) -> DataFrame:
    """(key, reason) of every issue of every record: letters, length, repeats, presence in the reference, similarity above a limit.

    A record can have several; a repeat is any but the first of a text by order.
    """
    s = F.col(text)
    first = df.groupBy(text).agg(F.min(order).alias("_first"), F.count("*").alias("_n")).where("_n > 1").withColumnRenamed(text, "_t")
    known = reference.select(F.col(text).alias("_r")).where("_r IS NOT NULL").distinct()
    rows = df.join(first, s == F.col("_t"), "left").join(known, s == F.col("_r"), "left")
    if similarity_max is not None:
        near = joins.above(df.select(F.col(key).alias("id"), text), reference, text, similarity_max).select(F.col("id").alias("_near"))
        rows = rows.join(near, F.col(key) == F.col("_near"), "left")
    rules = {
        "invalid_alphabet": ~s.rlike(f"^[{seq.LETTERS}]*$") | s.isNull(), "length_out_of_range": ~F.length(s).between(low, high), "duplicate_sequence": F.col(order) > F.col("_first"),
        "exact_reference_overlap": F.col("_r").isNotNull(), **({"challenge_similarity_exceeded": F.col("_near").isNotNull()} if similarity_max is not None else {}),
    }
    return rows.select(key, F.explode(F.array_compact(F.array(*[F.when(F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items()]))).alias("reason"))


def submission_issues(library: DataFrame, top: DataFrame, ranking: DataFrame, text: str, size: int, k: int) -> DataFrame:
    """(reason, n): what is wrong with a library (text), a top list (text, place) and a ranking (text, rank, score) taken together.

    Sizes, repeats, the top list within the library and in the order of the ranking, ranks from 1 on without
    gaps, scores that never rise. Counts, one row each, meet in the end.
    """
    n = lambda df, name: df.agg(F.count("*").alias("n"), F.countDistinct(text).alias("d")).select(F.lit(name).alias("t"), "n", "d")
    sizes = n(library, "library").unionByName(n(top, "top"))
    want = F.when(F.col("t") == "library", size).otherwise(k)
    counted = sizes.select(F.explode(F.array(F.struct(F.concat("t", F.lit("_size")).alias("reason"), F.abs(F.col("n") - want).alias("n")), F.struct(F.concat("t", F.lit("_repeats")).alias("reason"), (F.col("n") - F.col("d")).alias("n")))).alias("x")).select("x.*")
    outside = top.join(library.select(text).distinct(), text, "left_anti").agg(F.lit("top_not_in_library").alias("reason"), F.count("*").alias("n"))
    order = top.join(ranking, text, "left").agg(F.lit("top_order_differs").alias("reason"), F.count_if(~F.col("rank").eqNullSafe(F.col("place"))).alias("n"))
    ranks = ranking.agg(F.lit("ranks_not_contiguous").alias("reason"), (F.abs(F.max("rank") - F.count("*")) + F.abs(F.min("rank") - 1) + F.count("*") - F.countDistinct("rank")).alias("n"))
    blocks = ranking.groupBy(F.floor(F.col("rank") / 1000).alias("b")).agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("l"))  # a thousand ranks each
    rises = blocks.select(F.aggregate("l", F.struct(F.lit(None).cast("double").alias("s"), F.lit(0).alias("n")), lambda a, x: F.struct(x["score"].cast("double").alias("s"), (a["n"] + F.when(x["score"] > a["s"], 1).otherwise(0)).alias("n")))["n"].alias("n"))
    rising = rises.agg(F.lit("scores_rise").alias("reason"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return counted.unionByName(outside).unionByName(order).unionByName(ranks).unionByName(rising).where("n > 0").select("reason", F.col("n").cast("long").alias("n"))


def library_identity(df: DataFrame, text: str, place: str | None = None) -> str:
    """A digest of a table of texts: of the set (order-free), or with a place of the order too. Rows are digested before they meet."""
    row = F.sha2(F.concat_ws(":", F.col(place).cast("string"), F.col(text)) if place else F.col(text), 256)
    halves = [F.conv(F.substring(row, i, 15), 16, 10).cast("decimal(38,0)") for i in (1, 16, 31, 46)]
    got = df.select(*[h.alias(f"h{i}") for i, h in enumerate(halves)]).agg(F.count("*"), *[F.sum(f"h{i}") for i in range(4)]).first()
    import hashlib

    return hashlib.sha256(":".join(map(str, got)).encode()).hexdigest()


def require_repeat(a: dict, b: dict, fields: list[str]) -> None:
    """Two runs' manifests agree in every field named; a field that is missing counts as different."""
    if bad := [f for f in fields if f not in a or f not in b or a[f] != b[f]]:
        raise ContractError(f"the runs differ in {bad}")


def file_digest(spark, path: str) -> str:
    """sha256 of the files of a path as Spark reads them: each file's digest, by name."""
    import hashlib

    rows = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha")).orderBy("name").collect()
    return hashlib.sha256("\n".join(f"{r.name}:{r.sha}" for r in rows).encode()).hexdigest()


def require_unchanged(spark, digests: dict[str, str]) -> None:
    if bad := [p for p, d in digests.items() if file_digest(spark, p) != d]:
        raise ContractError(f"inputs changed: {bad}")


def require_fresh(output: str, inputs: list[str]) -> None:
    """An output that isn't, holds or lies in an input."""
    clean = lambda p: p.rstrip("/") + "/"
    if bad := [i for i in inputs if clean(i).startswith(clean(output)) or clean(output).startswith(clean(i))]:
        raise ContractError(f"the output overlaps inputs {bad}")


def reusable(manifest: dict, settings: dict, members: DataFrame, key: str) -> bool:
    """Whether a finished fit can serve: equal settings, and members of the same digest."""
    return manifest.get("settings") == settings and manifest.get("members") == library_identity(members, key)


def require_covered_vectors(df: DataFrame, vectors: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """The rows with their vector, each of which must be there, of that width and finite."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    bad = F.col(vector).isNull() | (F.size(vector) != width) | ~whole
    joined = df.join(joins.require_unique(vectors.select(key, vector), [key], "vectors"), key, "left")
    if found := joined.where(bad).take(1):
        raise ContractError(f"no sound vector for {found[0][key]!r}")
    return joined


def quality_report(df: DataFrame, finite: list[str], key: str, expected: DataFrame, quotas: DataFrame, group: str) -> DataFrame:
    """(check, n): values that aren't finite by column, keys missing or unexpected, groups whose rows differ from their quota (group, quota)."""
    bad = [F.struct(F.lit(f"not_finite:{c}").alias("check"), F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))).alias("n")) for c in finite]
    values = df.agg(F.array(*bad).alias("x")).select(F.explode("x").alias("x")).select("x.check", "x.n")
    keys = df.select(key).distinct().withColumn("a", F.lit(1)).unionByName(expected.select(key).distinct().withColumn("b", F.lit(1)), allowMissingColumns=True).groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    sides = keys.agg(F.array(F.struct(F.lit("missing_key").alias("check"), F.count_if(F.col("a").isNull()).alias("n")), F.struct(F.lit("unexpected_key").alias("check"), F.count_if(F.col("b").isNull()).alias("n"))).alias("x")).select(F.explode("x").alias("x")).select("x.check", "x.n")
    have = df.groupBy(group).agg(F.count("*").alias("_n")).join(quotas, group, "full").agg(F.lit("quota_differs").alias("check"), F.count_if(F.coalesce("_n", F.lit(0)) != F.coalesce("quota", F.lit(0))).alias("n"))
    return values.unionByName(sides).unionByName(have)


def duplicate_flags(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Add repeated: an earlier row has equal keys, null equal to null."""
    return df.withColumn("repeated", F.row_number().over(W.partitionBy(*keys).orderBy(order)) > 1)
