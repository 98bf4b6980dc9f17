"""Quotas over small spines of keys, for many groups at once: remainders, capacities, redistribution, blends."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from . import select
from .graph import cut


def largest_remainder(weights: DataFrame, key: str, weight: str, total: int | str, by: list[str] | None = None) -> DataFrame:
    """(by, key, quota): floors of the exact shares, the rest by largest remainder, then smaller key.

    ``total`` is a number or a column that is the same for all rows of a group. A spine of keys is small.
    """
    by = by or []
    group = W.partitionBy(*by)
    whole = F.lit(total) if isinstance(total, int) else F.col(total)
    exact = weights.withColumn("_exact", whole * F.col(weight) / F.sum(weight).over(group)).withColumn("_floor", F.floor("_exact"))
    left = whole - F.sum("_floor").over(group)
    n = F.row_number().over(group.orderBy((F.col("_exact") - F.col("_floor")).desc(), key))
    return exact.withColumn("_left", left).withColumn("_n", n).select(*by, key, (F.col("_floor") + (F.col("_n") <= F.col("_left")).cast("long")).alias("quota"))


def histogram_weights(df: DataFrame, key: str, low: int, high: int, temperature: float | None) -> DataFrame:
    """(key, weight) for every whole key of [low, high]: 1, or (rows of that key + 1) ** temperature."""
    spine = df.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias(key))
    if temperature is None:
        return spine.withColumn("weight", F.lit(1.0))
    counts = df.groupBy(F.col(key).cast("int").alias(key)).agg(F.count("*").alias("_n"))
    return spine.join(counts, key, "left").select(key, F.pow(F.coalesce("_n", F.lit(0)) + 1.0, F.lit(temperature)).alias("weight"))


def length_quotas(df: DataFrame, key: str, total: int, low: int, high: int, temperature: float | None = 0.75) -> DataFrame:
    """(key, quota) of a uniform (no temperature) or tempered spread of the total over the keys of [low, high]."""
    return largest_remainder(histogram_weights(df, key, low, high, temperature), key, "weight", total)


def bounded_quotas(table: DataFrame, group: str, key: str, weight: str, capacity: str, total: str) -> DataFrame:
    """(group, key, quota): each group's total shared by weight, no key above its capacity.

    Rounds of shares of what is left over the keys that are still open: whole parts first, cut at the
    capacity; then single units by largest remainder, ties to the smaller key, to keys that are still open.
    Where all weights left are zero, spare capacity weighs. All groups go through a round together, as
    windows; each round fills a key or ends a group. A total above a group's capacity is an error.
    """
    w = W.partitionBy(group)
    cap, q = F.col("_cap"), F.col("_q")
    cur = table.select(group, key, F.coalesce(weight, F.lit(0.0)).cast("double").alias("_w"), F.col(capacity).cast("long").alias("_cap"), F.col(total).cast("long").alias("_total"), F.lit(0).cast("long").alias("_q"))
    short = F.when(F.sum(cap).over(w) < F.col("_total"), F.raise_error(F.lit("fewer rows than the total")).cast("long"))
    cur = cut(cur.withColumn("_q", F.coalesce(short, q)))
    while not cur.withColumn("_left", F.col("_total") - F.sum(q).over(w)).where("_left > 0").isEmpty():
        step = cur.withColumn("_left", F.col("_total") - F.sum(q).over(w)).withColumn("_m", F.when(q < cap, F.col("_w")).otherwise(0.0))
        step = step.withColumn("_m", F.when(F.sum("_m").over(w) > 0, F.col("_m")).otherwise((cap - q).cast("double")))
        step = step.withColumn("_ideal", F.col("_left") * F.col("_m") / F.nullif(F.sum("_m").over(w), F.lit(0.0)))
        step = step.withColumn("_open", q < cap).withColumn("_q", q + F.least(F.floor(F.coalesce("_ideal", F.lit(0.0))), cap - q))
        step = step.withColumn("_left", F.col("_total") - F.sum(q).over(w)).withColumn("_can", F.col("_open") & (q < cap))
        n = F.row_number().over(w.orderBy(F.col("_can").desc(), (F.col("_ideal") - F.floor("_ideal")).desc(), key))
        step = step.withColumn("_n", n)
        cur = cut(step.select(group, key, "_w", "_cap", "_total", (q + (F.col("_can") & (F.col("_n") <= F.col("_left"))).cast("long")).alias("_q")))
    return cur.select(group, key, F.col("_q").alias("quota"))


def redistribute(table: DataFrame, key: str, target: str, available: str) -> tuple[DataFrame, DataFrame]:
    """((key, quota), (source, destination, n)): what a key lacks is taken from the nearest keys with rows to spare, ties to the smaller.

    Keys that lack rows are served from the smallest on; one is served in one step: the keys with spare rows
    stand by distance, and each gives what those before it leave open. For a spine of keys; more asked for
    than there is is an error.
    """

    def serve(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        rows = rows.sort_values("k")
        keys, want, have = (rows[c].to_numpy() for c in ("k", "want", "have"))
        quota = np.minimum(want, have)
        out = []
        for at in np.flatnonzero(want > quota):
            spare = have - quota
            near = np.lexsort((keys, np.abs(keys - keys[at])))
            ahead = np.cumsum(spare[near]) - spare[near]
            give = np.clip(want[at] - min(want[at], have[at]) - ahead, 0, spare[near])
            if give.sum() < want[at] - min(want[at], have[at]):
                raise ValueError("fewer rows than the quotas ask for")
            quota[near] += give
            out += [(keys[at], keys[j], n) for j, n in zip(near, give) if n]
        moves = pd.DataFrame(out, columns=["source", "destination", "n"])
        kept = pd.DataFrame({"source": keys, "destination": -1, "n": quota}).assign(move=False)
        return pd.concat([kept, moves.assign(move=True)])[["source", "destination", "n", "move"]].astype({"source": "int64", "destination": "int64", "n": "int64", "move": "bool"})

    spine = table.select(F.lit(1).alias("_g"), F.col(key).cast("long").alias("k"), F.col(target).cast("long").alias("want"), F.col(available).cast("long").alias("have"))
    done = cut(spine.groupBy("_g").applyInPandas(serve, "source long, destination long, n long, move boolean"))
    kind = table.schema[key].dataType
    return done.where("NOT move").select(F.col("source").cast(kind).alias(key), F.col("n").alias("quota")), done.where("move").select(F.col("source").cast(kind).alias("source"), F.col("destination").cast(kind).alias("destination"), "n")


def by_quota(df: DataFrame, quotas: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first ``quota`` rows of each key group, by order; quotas has one row a key group."""
    ranked = df.join(quotas, keys).withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_nth <= quota").drop("_nth", "quota")


def library(df: DataFrame, variant: str, size: int, quotas: DataFrame | None, group: str, cluster: str, order: list[Column], raw: str) -> DataFrame:
    """A library of ``size`` valid rows: L0 by raw order, L1 by quota and quality, L2 by quota and turns over clusters.

    Quotas (group, quota) are moved to where rows are (``redistribute``) first.
    """
    if variant == "L0":
        return df.orderBy(raw).limit(size)
    have = df.groupBy(group).agg(F.count("*").alias("have"))
    spine = quotas.join(have, group, "left").select(group, F.col("quota").alias("want"), F.coalesce("have", F.lit(0)).alias("have"))
    actual, _ = redistribute(spine, group, "want", "have")
    rows = df.join(F.broadcast(actual), group)
    if variant == "L1":
        return select.top_per_group(rows, group, order, F.col("quota")).drop("quota")
    return select.round_robin(rows, group, cluster, order, F.col("quota")).drop("quota")


def reference_mix(pool: DataFrame, chosen: DataFrame, reference: DataFrame, group: str, cluster: str, order: list[Column], fraction: float) -> DataFrame:
    """As many rows of each group as ``chosen`` has, its clusters' shares blended with the reference's, capped by supply."""

    def share(df: DataFrame, name: str) -> DataFrame:
        n = df.groupBy(group, cluster).agg(F.count("*").alias("_n"))
        return n.select(group, cluster, (F.col("_n") / F.sum("_n").over(W.partitionBy(group))).alias(name))

    supply = pool.groupBy(group, cluster).agg(F.count("*").alias("_cap")).join(chosen.groupBy(group).agg(F.count("*").alias("_want")), group)
    mixed = supply.join(share(chosen, "_own"), [group, cluster], "left").join(share(reference, "_ref"), [group, cluster], "left")
    weight = (1 - fraction) * F.coalesce("_own", F.lit(0.0)) + fraction * F.coalesce("_ref", F.lit(0.0))
    return by_quota(pool, bounded_quotas(mixed.withColumn("_weight", weight), group, cluster, "_weight", "_cap", "_want"), [group, cluster], order)


def option_grid(spark: SparkSession, **options: list) -> DataFrame:
    """One row for each combination of the options' values."""
    grid = spark.range(1).select()
    for name, values in options.items():
        grid = grid.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    return grid
