"""Summaries, cube reductions and distances between distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .rank import beside_quantiles, quantiles


def summary(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Ten numbers: count, mean, population deviation, minimum, five exact percentiles, maximum."""
    out = df.groupBy(*(by or [])).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    out = beside_quantiles(out, df, value, (0.05, 0.25, 0.5, 0.75, 0.95), by)
    names = ("p05", "p25", "p50", "p75", "p95")
    return out.select(*(by or []), "n", "mean", "std", "min", *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(names)], "max")


def cube(df: DataFrame, row: str, target: str, value: str, threshold: float = 16.0) -> DataFrame:
    """Reductions of a long (row, model, target, value) cube: by target, over models, then over targets.

    broad_mean: mean of target means; vote: mean share of models at or below the threshold; median and q90 of
    log2 target means; worst3: mean of the three highest; mad: median absolute deviation of log2 values, over all.
    """
    low = (F.col(value) <= threshold).cast("double")
    targets = df.groupBy(row, target).agg(F.avg(value).alias("_m"), F.avg(low).alias("_s"), F.collect_list(F.log2(value)).alias("_x"))  # a value a model
    rows = targets.groupBy(row).agg(F.avg("_m").alias("broad_mean"), F.avg("_s").alias("vote"), F.sort_array(F.collect_list(F.log2("_m"))).alias("_t"), F.sort_array(F.flatten(F.collect_list("_x"))).alias("_v"))
    worst = F.slice(F.reverse("_t"), 1, 3)
    mid = tail(F.col("_v"), 0.5)
    return rows.withColumn("_mid", mid).select(
        row, "broad_mean", "vote", tail(F.col("_t"), 0.5).alias("median_log2"), tail(F.col("_t"), 0.9).alias("q90_log2"), (F.aggregate(worst, F.lit(0.0), lambda a, x: a + x) / F.size(worst)).alias("worst3_log2"),
        tail(F.transform("_v", lambda x: F.abs(x - F.col("_mid"))), 0.5).alias("mad_log2"),
    )


def shares(df: DataFrame, key: str) -> DataFrame:
    """(key, share) of the rows."""
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("_n").alias("_all")))).select(key, (F.col("_n") / F.col("_all")).alias("share"))  # one row


def total_variation(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Half the sum of absolute differences of shares, over the keys of either."""
    x, y = shares(a, key).withColumnRenamed("share", "_a"), shares(b, key).withColumnRenamed("share", "_b")
    both = x.join(y, x[key].eqNullSafe(y[key]), "full")
    return both.agg((F.sum(F.abs(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))) / 2).alias("distance"))


def mode(df: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value of each group, ties to the smaller."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(group).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(value))


def macro_mean(df: DataFrame, levels: list[str], value: Column, out: str) -> DataFrame:
    """Mean of means: over the last level within the ones before it, and so on."""
    cur = df.groupBy(*levels).agg(F.avg(value).alias(out))
    for n in range(len(levels) - 1, 0, -1):
        cur = cur.groupBy(*levels[:n]).agg(F.avg(out).alias(out))
    return cur


def standardised(df: DataFrame, run: str, stratum: str, value: str, reference: DataFrame) -> DataFrame:
    """Mean of each run by stratum, weighted by the reference's strata, over the strata that all runs have."""
    cells = df.groupBy(run, stratum).agg(F.avg(value).alias("_m"))
    runs = cells.agg(F.countDistinct(run).alias("_runs"))
    common = cells.groupBy(stratum).agg(F.countDistinct(run).alias("_k")).crossJoin(F.broadcast(runs)).where("_k = _runs").select(stratum)  # one row
    weights = reference.groupBy(stratum).agg(F.count("*").alias("_w")).join(common, stratum, "left_semi")
    return cells.join(weights, stratum).groupBy(run).agg((F.sum(F.col("_m") * F.col("_w")) / F.sum("_w")).alias(value))


def ground_truth(df: DataFrame, key: str, value: str, threshold: float) -> DataFrame:
    """A key's success rate, median and 90th percentile of log2 values, and the share of successes that are halved too."""
    low = (F.col(value) <= threshold).cast("double")
    strict = (F.col(value) <= threshold / 2).cast("double")
    return df.groupBy(key).agg(F.avg(low).alias("success"), F.percentile(F.log2(value), 0.5).alias("q50"), F.percentile(F.log2(value), 0.9).alias("q90"), F.avg(strict).alias("conservative"))


def inverse_size_weights(df: DataFrame, group: str, out: str = "weight") -> DataFrame:
    """One over the group's size, over the sum of all: groups count alike. Sizes are counted before the join."""
    sizes = df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
    groups = sizes.agg(F.count("*").alias("_k"))
    return df.join(sizes, F.col(group).eqNullSafe(F.col("_g"))).crossJoin(F.broadcast(groups)).withColumn(out, 1.0 / (F.col("_n") * F.col("_k"))).drop("_g", "_n", "_k")  # one row


def exceedance(df: DataFrame, reference: DataFrame, features: list[str], out: str = "exceeds") -> DataFrame:
    """Share of a row's features outside the reference's range."""
    ends = reference.agg(*[F.min(c).alias(f"_lo_{c}") for c in features], *[F.max(c).alias(f"_hi_{c}") for c in features])
    outside = sum(((F.col(c) < F.col(f"_lo_{c}")) | (F.col(c) > F.col(f"_hi_{c}"))).cast("int") for c in features)
    return df.crossJoin(F.broadcast(ends)).withColumn(out, outside / F.lit(len(features))).select(*df.columns, out)  # one row


def error_slices(df: DataFrame, slices: list[str], error: str) -> DataFrame:
    """(slice, value, n, mae) over several grouping columns in one pass."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("slice"), F.col(c).cast("string").alias("value")) for c in slices])).alias("s"), error)
    return long.groupBy("s.slice", "s.value").agg(F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"))


def rule_ablation(df: DataFrame, reasons: str, rules: list[str], positive: str) -> DataFrame:
    """(removed, kept, positives_kept): how many rows pass, and how many of the positives, when one rule is left out."""
    grid = df.withColumn("removed", F.explode(F.array(*[F.lit(r) for r in rules])))
    passes = F.size(F.array_except(reasons, F.array("removed"))) == 0
    return grid.groupBy("removed").agg(F.sum(passes.cast("long")).alias("kept"), F.sum((passes & F.col(positive)).cast("long")).alias("positives_kept"))


def deduplicated_total(df: DataFrame, key: str, cost: str) -> DataFrame:
    """Sum of costs with each key once; ``conflicts`` counts keys of several costs."""
    once = df.groupBy(key).agg(F.min(cost).alias("_lo"), F.max(cost).alias("_hi"))
    return once.agg(F.sum("_lo").alias("total"), F.sum((~F.col("_lo").eqNullSafe(F.col("_hi"))).cast("long")).alias("conflicts"))


def five_numbers(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Mean, population deviation, 10th, 50th and 90th percentile."""
    out = df.groupBy(*(by or [])).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    out = beside_quantiles(out, df, value, (0.1, 0.5, 0.9), by)
    return out.select(*(by or []), "mean", "std", *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(("p10", "p50", "p90"))])


def mean_of(values: Column, places: list[int | tuple[int, ...]]) -> Column:
    """Mean over places (from 0) of an array; a tuple of places counts once, by its smallest value."""
    terms = [F.least(*[F.get(values, F.lit(i)) for i in p]) if isinstance(p, tuple) else F.get(values, F.lit(p)) for p in places]
    return sum(terms, F.lit(0.0)) / len(terms)


def tail(values: Column, share: float) -> Column:
    """A quantile of an array, linearly interpolated."""
    s, at = F.array_sort(values), (F.size(values) - 1) * F.lit(share)
    low, high = F.get(s, F.floor(at).cast("int")), F.get(s, F.ceil(at).cast("int"))
    return low + (high - low) * (at - F.floor(at))


def two_level_votes(df: DataFrame, row: str, target: str, vote: str, families: DataFrame) -> DataFrame:
    """(row, mean, worst3): votes averaged over a family's targets (families: target, family), then over families and over the three lowest."""
    per = df.join(F.broadcast(families), target).groupBy(row, "family").agg(F.avg(vote).alias("v"))  # a small map of targets
    low = F.slice(F.sort_array(F.collect_list("v")), 1, 3)
    return per.groupBy(row).agg(F.avg("v").alias("mean"), low.alias("_w")).select(row, "mean", (F.aggregate("_w", F.lit(0.0), lambda a, x: a + x) / F.size("_w")).alias("worst3"))


def complete_means(df: DataFrame, key: str, target: str, value: str, targets: list[str]) -> DataFrame:
    """(key, mean) of keys that have every target; the others are left out."""
    known = df.where(F.col(target).isin(targets) & F.col(value).isNotNull())
    return known.groupBy(key).agg(F.avg(value).alias("mean"), F.countDistinct(target).alias("_n")).where(F.col("_n") == len(targets)).drop("_n")


def screen_tally(df: DataFrame, run: str, text: str, valid: Column, common: Column) -> DataFrame:
    """(run, raw, valid, unique, common_valid, common_unique) of generated rows."""
    ok = F.coalesce(valid, F.lit(False))
    return df.groupBy(run).agg(
        F.count("*").alias("raw"), F.count_if(ok).alias("valid"), F.countDistinct(F.when(ok, F.col(text))).alias("unique_valid"),
        F.count_if(ok & common).alias("common_valid"), F.countDistinct(F.when(ok & common, F.col(text))).alias("common_unique"),
    )


def reference_statistics(df: DataFrame, columns: list[str], at: tuple[float, ...] = (0.005, 0.01, 0.25, 0.5, 0.75, 0.99, 0.995)) -> DataFrame:
    """(feature, q0, q1, ...) exact quantiles of each column, columns of a kind counted in one pass."""
    out = None
    for c, q in quantiles(df, columns, at).items():
        row = q.select(F.lit(c).alias("feature"), *[F.get("q", F.lit(i)).alias(f"q{i}") for i in range(len(at))])
        out = row if out is None else out.unionByName(row)
    return out


def robust_scores(df: DataFrame, columns: list[str], statistics: DataFrame, clip: float = 10.0, extreme: int = 3) -> DataFrame:
    """Add ood, the mean absolute robust z, n_extreme, how many columns lie outside q0..q6, and hard_reject (so many or more).

    statistics: reference_statistics of the columns; z is (x - median) over the quartile distance, clipped.
    """
    table = statistics.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("q0", "q2", "q3", "q4", "q6")))).alias("_s"))  # one row a feature
    z = lambda c: F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.col(c) - F.col("_s")[c]["q3"]) / F.greatest(F.col("_s")[c]["q4"] - F.col("_s")[c]["q2"], F.lit(1e-6))))
    outside = [((F.col(c) < F.col("_s")[c]["q0"]) | (F.col(c) > F.col("_s")[c]["q6"])).cast("int") for c in columns]
    out = df.crossJoin(F.broadcast(table)).withColumn("ood", sum((F.abs(z(c)) for c in columns), F.lit(0.0)) / len(columns)).withColumn("n_extreme", sum(outside, F.lit(0)))  # one row
    return out.withColumn("hard_reject", F.col("n_extreme") >= extreme).drop("_s")


def cohort_metrics(df: DataFrame, run: str, text: str, value: str, common: Column, known: DataFrame) -> DataFrame:
    """(run, scope, n, distinct_n, novel, coverage, median): each run as it is and over common rows only; novel: distinct texts that ``known`` lacks."""
    seen = known.select(F.col(text).alias("_k")).distinct()
    rows = df.join(seen, F.col(text) == F.col("_k"), "left").withColumn("scope", F.explode(F.when(F.coalesce(common, F.lit(False)), F.array(F.lit("native"), F.lit("common"))).otherwise(F.array(F.lit("native")))))
    out = rows.groupBy(run, "scope").agg(
        F.count("*").alias("n"), F.countDistinct(text).alias("distinct_n"), F.countDistinct(F.when(F.col("_k").isNull(), F.col(text))).alias("novel"),
        (F.count(value) / F.count("*")).alias("coverage"),
    )
    return beside_quantiles(out, rows, value, (0.5,), [run, "scope"]).withColumn("median", F.get("_q", F.lit(0))).drop("_q")


def sorted_list(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values): the distinct values of a key, sorted, as JSON."""
    return df.groupBy(key).agg(F.to_json(F.array_sort(F.collect_set(value))).alias("values"))


def metric_slices(df: DataFrame, slices: list[str], error: str, cohort: Column) -> DataFrame:
    """(slice, value, cohort, n, mae, rmse, within1) over several grouping columns, for all rows and for a cohort, in one pass."""
    pick = F.explode(F.array(*[F.struct(F.lit(c).alias("slice"), F.col(c).cast("string").alias("value")) for c in slices]))
    both = F.when(F.coalesce("_c", F.lit(False)), F.array(F.lit("all"), F.lit("cohort"))).otherwise(F.array(F.lit("all")))
    long = df.select(pick.alias("s"), cohort.alias("_c"), F.col(error).alias("e")).select("s", "e", F.explode(both).alias("cohort"))
    return long.groupBy("s.slice", "s.value", "cohort").agg(F.count("e").alias("n"), F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg((F.abs("e") <= 1).cast("double")).alias("within1"))


def one_cost_total(df: DataFrame, key: str, cost: str) -> DataFrame:
    """Sum of costs with each key once; a key of several costs is an error."""
    once = df.groupBy(key).agg(F.min(cost).alias("_lo"), F.max(cost).alias("_hi"))
    same = F.when(F.col("_lo").eqNullSafe(F.col("_hi")), F.col("_lo")).otherwise(F.raise_error(F.lit("one key has several costs")).cast("double"))
    return once.agg(F.sum(same).alias("total"))


def retention(df: DataFrame, reasons: str, rules: list[str], by: str, lower: str, upper: str) -> DataFrame:
    """(removed, by, positives, negatives): the share of sure positives, and of sure negatives, of each group that pass when one rule is left out."""
    grid = df.withColumn("removed", F.explode(F.array(*[F.lit(r) for r in rules])))
    passes = (F.size(F.array_except(reasons, F.array("removed"))) == 0).cast("double")
    return grid.groupBy("removed", by).agg(F.avg(F.when(F.col(lower) == 1, passes)).alias("positives"), F.avg(F.when(F.col(upper) == 0, passes)).alias("negatives"))
