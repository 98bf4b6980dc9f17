"""Draws and bootstraps over index tables that NumPy makes from a seed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .graph import cut


def draws(spark: SparkSession, rows: int, size: int, n: int, seed: int = 42, replace: bool = False) -> DataFrame:
    """(draw, position) of n draws; n * size positions, a parameter, not data."""
    r = np.random.default_rng(seed)
    return spark.createDataFrame([(d, int(i)) for d in range(n) for i in r.choice(rows, size, replace=replace)], "draw int, position long")


def over_draws(df: DataFrame, position: str, index: DataFrame, value: str) -> DataFrame:
    """Mean of the value in each draw."""
    return index.join(df, index.position == df[position]).groupBy("draw").agg(F.avg(value).alias("mean"))


def hash_index(n: Column, *parts: Column) -> Column:
    """A whole number in [0, n) from the SHA-256 of the parts, which any engine can repeat."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long"), n.cast("long"))


def cluster_draws(df: DataFrame, cluster: str, sums: dict[str, Column], rounds: int, seed: int) -> DataFrame:
    """(round, times, cluster, sums): in each round as many clusters as there are, drawn with replacement, and the sums over a cluster's rows.

    Clusters are numbered in order; the j-th draw of a round takes number hash(seed:round:j) modulo how many
    there are. Draws of one number are counted first, so a cluster stands once a round, with how many times.
    """
    from . import rank

    per = cut(df.groupBy(cluster).agg(*[c.alias(n) for n, c in sums.items()]))
    numbered = rank.with_ranks(per, {"_i": F.col(f"{cluster}_before"), "_n": F.col(f"{cluster}_total")}, [cluster])
    n = per.count()
    draws = df.sparkSession.range(n).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    counts = draws.select("round", hash_index(F.lit(max(n, 1)), F.lit(seed), F.col("round"), F.col("id")).alias("_d")).groupBy("round", "_d").agg(F.count("*").alias("times"))
    return counts.join(numbered, F.col("_d") == F.col("_i")).drop("_d", "_i", "_n")


def interval(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.percentile(value, 0.025).alias("low"), F.percentile(value, 0.5).alias("mid"), F.percentile(value, 0.975).alias("high"))


def cluster_bootstrap(df: DataFrame, cluster: str, value: str, rounds: int = 100, seed: int = 42) -> DataFrame:
    """Interval of the mean when whole clusters are drawn again, as many as there are."""
    drawn = cluster_draws(df, cluster, {"s": F.sum(value), "n": F.count(value)}, rounds, seed)
    means = drawn.groupBy("round").agg((F.sum(F.col("times") * F.col("s")) / F.nullif(F.sum(F.col("times") * F.col("n")), F.lit(0))).alias("mean"))
    return interval(means, "mean")


def paired_bootstrap(df: DataFrame, key: str, a: str, b: str, rounds: int = 100, seed: int = 42) -> DataFrame:
    """(low, mid, high, not_worse): rows drawn again, interval of mean(b) - mean(a), and the share of rounds in which b isn't worse (lower)."""
    drawn = cluster_draws(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), key, {"d": F.sum(F.col(b) - F.col(a)), "n": F.count("*")}, rounds, seed)
    deltas = drawn.groupBy("round").agg((F.sum(F.col("times") * F.col("d")) / F.sum(F.col("times") * F.col("n"))).alias("delta"))
    return deltas.agg(F.percentile("delta", 0.025).alias("low"), F.percentile("delta", 0.5).alias("mid"), F.percentile("delta", 0.975).alias("high"), F.avg((F.col("delta") >= 0).cast("double")).alias("not_worse"))


def component_delta(df: DataFrame, component: str, species: str, delta: str, rounds: int = 200, seed: int = 42, least: int = 5) -> DataFrame:
    """(macro, low, high, rounds): mean over species of mean deltas, with an interval over components drawn again.

    A round that lacks a species is left out, as it would change what is averaged; with fewer than
    ``least`` components there is no interval.
    """
    rows = df.where(F.col(delta).isNotNull())
    macro = rows.groupBy(species).agg(F.avg(delta).alias("m")).agg(F.avg("m").alias("macro"), F.count("*").alias("_s"))
    cells = F.map_from_entries(F.collect_list(F.struct(F.col(species), F.struct(F.col("_sum").alias("s"), F.col("_rows").alias("n")))))
    pre = cut(rows.groupBy(component, species).agg(F.sum(delta).alias("_sum"), F.count("*").alias("_rows")))
    drawn = cluster_draws(pre, component, {"cells": cells}, rounds, seed)
    per = drawn.select("round", "times", F.explode("cells").alias("sp", "c")).groupBy("round", "sp").agg((F.sum(F.col("times") * F.col("c.s")) / F.sum(F.col("times") * F.col("c.n"))).alias("m"))
    means = per.groupBy("round").agg(F.avg("m").alias("m"), F.count("*").alias("_k")).crossJoin(F.broadcast(macro)).where("_k = _s")  # one row
    got = means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"), F.count("*").alias("rounds"))
    n = pre.select(component).distinct().count()
    enough = F.lit(n >= least)
    return macro.crossJoin(got).select("macro", F.when(enough, F.col("low")).alias("low"), F.when(enough, F.col("high")).alias("high"), F.when(enough, F.col("rounds")).otherwise(0).alias("rounds"))  # one row each


def random_panels(df: DataFrame, key: str, values: list[str], size: int, n: int, seed: int = 42) -> DataFrame:
    """(draw, <value>_mean, ..): n draws of ``size`` rows without replacement, NumPy's by position in key order, and each one's means."""
    from . import rank

    total = df.count()
    index = draws(df.sparkSession, total, min(size, total), n, seed)
    placed = rank.ordinal(df.select(key, *values), key, "_at")
    return F.broadcast(index).join(placed, F.col("position") == F.col("_at")).groupBy("draw").agg(*[F.avg(v).alias(f"{v}_mean") for v in values])


#: How panel_metrics() makes a number of a column: the last two are null where a row of the draw has no value.
PANEL_KINDS = {
    "mean": lambda c: F.avg(c.cast("double")),
    "median": lambda c: F.median(c.cast("double")),
    "distinct": lambda c: F.count_distinct(c).cast("double"),
    "mean_of_all": lambda c: F.when(F.count(c) == F.count("*"), F.avg(c.cast("double"))),
    "median_of_all": lambda c: F.when(F.count(c) == F.count("*"), F.median(c.cast("double"))),
}


def panel_metrics(df: DataFrame, key: str, metrics: dict[str, tuple[Column, str]], size: int, n: int, seed: int = 42) -> DataFrame:
    """(draw, a column a metric): n draws of ``size`` rows without replacement, NumPy's by position in key order; metrics: {name: (column, kind)}."""
    from . import rank

    total = df.count()
    if not 0 < size <= total or n < 1:
        raise ValueError(f"{n} draws of {size} of {total} rows")
    placed = rank.ordinal(df.select(key, *[c.alias(f"_v{i}") for i, (c, _) in enumerate(metrics.values())]), key, "_at")
    drawn = placed.join(F.broadcast(draws(df.sparkSession, total, size, n, seed)), F.col("_at") == F.col("position"))  # n * size positions, parameters
    return drawn.groupBy("draw").agg(*[PANEL_KINDS[kind](F.col(f"_v{i}")).alias(name) for i, (name, (_, kind)) in enumerate(metrics.items())])


def panel_summary(panels: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, ten numbers) over the draws, of those metrics that every draw has."""
    from .aggregate import summary

    long = panels.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select("x.*")
    whole = long.groupBy("metric").agg((F.count("value") == F.count("*")).alias("_whole")).where("_whole").select(F.col("metric").alias("_m"))
    return summary(long.join(F.broadcast(whole), F.col("metric") == F.col("_m"), "left_semi"), "value", ["metric"])  # a row a metric


def seeded_panels(df: DataFrame, key: str, values: list[str], size: int, seeds: range) -> DataFrame:
    """As random_panels, one draw a seed."""
    total, rows = df.count(), []
    for s in seeds:
        rows += [(s, int(i)) for i in np.random.default_rng(s).choice(total, min(size, total), replace=False)]
    from . import rank

    index = df.sparkSession.createDataFrame(rows, "draw int, position long")
    placed = rank.ordinal(df.select(key, *values), key, "_at")
    return F.broadcast(index).join(placed, F.col("position") == F.col("_at")).groupBy("draw").agg(*[F.avg(v).alias(f"{v}_mean") for v in values])


def error_trials(df: DataFrame, key: str, mean: str, residuals: list[float], trials: int, seed: int, copula: str | None = None, rho: float = 0.0) -> DataFrame:
    """(key, trial, value): a prediction plus a residual drawn from an empirical quantile function, linear between residuals.

    The uniform of a draw is a hash of seed, trial and key; with a copula column, normal scores of rows that
    share it are correlated by ``rho``. The same trial of the same key is the same at any batch size.
    """
    import math

    table = np.sort(np.array(residuals, float))

    @F.pandas_udf("double")
    def quantile(u: pd.Series, shared: pd.Series) -> pd.Series:
        from statistics import NormalDist

        n = NormalDist()
        z = math.sqrt(1 - rho) * u.clip(1e-12, 1 - 1e-12).map(n.inv_cdf) + math.sqrt(rho) * shared.clip(1e-12, 1 - 1e-12).map(n.inv_cdf)
        return pd.Series(np.quantile(table, z.map(n.cdf).to_numpy()))

    unit = lambda *p: (hash_index(F.lit(1 << 52), *p) + 0.5) / float(1 << 52)
    grid = df.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    shared = unit(F.lit(seed + 1), F.col("trial"), F.col(copula) if copula else F.col(key))
    return grid.select(key, "trial", (F.col(mean) + quantile(unit(F.lit(seed), F.col("trial"), F.col(key)), shared)).alias("value"))


def scenario_expectations(hits: DataFrame, scenario: str, key: str, hit: str, size: int, draws_: int, seed: int = 42) -> DataFrame:
    """(expected, scenario_std, panel_std, panel_p10): hits of a panel of ``size`` keys drawn at random in a random scenario.

    expected: size times the mean hit rate; scenario_std: deviation over scenarios of that expectation;
    panel_*: over draws of one scenario and one panel each.
    """
    rates = hits.groupBy(scenario).agg(F.avg(F.col(hit).cast("double")).alias("r"), F.count("*").alias("n"))
    base = rates.agg((F.avg("r") * size).alias("expected"), (F.stddev_pop("r") * size).alias("scenario_std"))
    from . import rank

    scenarios = rank.ordinal(rates, scenario, "_s").select(scenario, "_s", "n")
    keys = rank.ordinal(hits.select(key).distinct(), key, "_k")
    total = rates.count()
    plan = hits.sparkSession.range(draws_).select(F.col("id").alias("draw"), hash_index(F.lit(max(total, 1)), F.lit(seed), F.lit("scenario"), F.col("id")).alias("_d"))
    plan = plan.join(scenarios, F.col("_d") == F.col("_s"))
    full = keys.count()
    spots = draws(hits.sparkSession, full, min(size, full), draws_, seed)
    panel = plan.join(spots.withColumnRenamed("draw", "_w"), F.col("draw") == F.col("_w")).join(keys, F.col("position") == F.col("_k"))
    summed = panel.join(hits, [scenario, key]).groupBy("draw").agg(F.sum(F.col(hit).cast("double")).alias("h"))
    return base.crossJoin(summed.agg(F.stddev_pop("h").alias("panel_std"), F.percentile("h", 0.1).alias("panel_p10")))  # one row each


def shuffled(text: Column, seed: int) -> Column:
    """The letters of a text in an order given by hashes of seed, text and place: the composition stays."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    marked = F.transform(letters, lambda c, i: F.struct(F.sha2(F.concat_ws(":", F.lit(str(seed)), text, i.cast("string")), 256).alias("h"), c.alias("c")))
    return F.array_join(F.transform(F.array_sort(marked), lambda x: x["c"]), "")


def stand_in_sequences(spark: SparkSession, quotas: dict[int, int], seed: int, letters: str = "ACDEFGHIKLMNPQRSTVWY") -> DataFrame:
    """(id, length, sequence): so many sequences of each length, letters by hashes of seed, number and place; a generator for tests."""
    rows = spark.createDataFrame(sorted(quotas.items()), "length int, n int").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    letter = lambda i: F.substring(F.lit(letters), hash_index(F.lit(len(letters)), F.lit(seed), F.col("length"), F.col("k"), i).cast("int") + 1, F.lit(1))
    return rows.select(F.format_string("seq_%d_%d", "length", "k").alias("id"), "length", F.array_join(F.transform(F.sequence(F.lit(1), F.col("length")), letter), "").alias("sequence"))
