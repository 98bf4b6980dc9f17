"""Ranks that treat ties as data frames do; neither percent_rank nor cume_dist does.

One table of distinct values serves all columns of a kind: (column, group, value, count) is dealt by value
ranges, each range is summed by itself, and the sums of the ranges before it are added. So a common value is
one row, and no task orders a whole column or a whole group, whatever its type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from .graph import cut


def finite(c: Column, kind: T.DataType | None = None) -> Column:
    """Neither null, NaN nor infinite."""
    if kind is not None and not isinstance(kind, (T.FloatType, T.DoubleType)):
        return c.isNotNull()
    x = c.cast("double")
    return c.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def _common(kind: T.DataType) -> T.DataType:
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return T.DoubleType()
    return T.LongType() if isinstance(kind, T.IntegralType) else kind


def value_ranks(df: DataFrame, columns: list[str], by: list[str] | None = None) -> dict[str, DataFrame]:
    """For each column a table (by as _b0.., _v, _before, _same, _total): how many rows of the group have a smaller value, that value, any.

    Null, NaN and infinite values are left out. The columns of one kind are counted in one pass.
    """
    by = by or []
    kinds: dict[str, list[str]] = {}
    for c in columns:
        kinds.setdefault(_common(df.schema[c].dataType).simpleString(), []).append(c)
    out = {}
    keys = [f"_b{i}" for i in range(len(by))]
    for kind, names in kinds.items():
        cells = [F.struct(F.lit(c).alias("c"), F.when(finite(F.col(c), df.schema[c].dataType), F.col(c)).cast(kind).alias("v")) for c in names]
        long = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], F.explode(F.array(*cells)).alias("x")).select(*keys, F.col("x.c").alias("_c"), F.col("x.v").alias("_v"))
        counts = long.where("_v IS NOT NULL").groupBy("_c", *keys, "_v").agg(F.count("*").alias("_same"))
        ranged = cut(counts.repartitionByRange("_c", *keys, "_v").withColumn("_p", F.spark_partition_id()))
        sums = ranged.groupBy("_c", *keys, "_p").agg(F.sum("_same").alias("_sum"))  # a row a range and group
        whole = W.partitionBy("_c", *keys)
        ahead = whole.orderBy("_p").rowsBetween(W.unboundedPreceding, 0)
        sums = sums.select("_c", *keys, "_p", (F.sum("_sum").over(ahead) - F.col("_sum")).alias("_ahead"), F.sum("_sum").over(whole).alias("_total"))
        within = W.partitionBy("_c", *keys, "_p").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
        ranged = ranged.withColumn("_own", F.sum("_same").over(within) - F.col("_same"))
        on = [ranged[c].eqNullSafe(sums[c]) for c in ("_c", *keys, "_p")]
        ranks = cut(ranged.join(sums, on).select(ranged["_c"], *[ranged[k] for k in keys], "_v", (F.col("_own") + F.col("_ahead")).alias("_before"), "_same", "_total"))
        for c in names:
            out[c] = ranks.where(F.col("_c") == c).drop("_c")
    return out


def quantiles(df: DataFrame, columns: list[str], at: tuple[float, ...], by: list[str] | None = None) -> dict[str, DataFrame]:
    """For each column a table (by as _b0.., q): its quantiles within groups, linearly interpolated, from the counts of distinct values.

    No task holds a column or a group. Null, NaN and infinite values are left out; a group without values has no row.
    """
    keys = [f"_b{i}" for i in range(len(by or []))]
    out = {}
    for c, ranks in value_ranks(df, columns, by).items():
        def value(place: Column) -> Column:
            return F.max(F.when((F.col("_before") <= place) & (place < F.col("_before") + F.col("_same")), F.col("_v").cast("double")))  # noqa: B023

        cells = []
        for q in at:
            place = F.lit(float(q)) * (F.col("_total") - 1)
            cells += [value(F.floor(place)), value(F.ceil(place)), F.max(place - F.floor(place))]
        got = ranks.groupBy(*keys).agg(*[x.alias(f"_x{i}") for i, x in enumerate(cells)])
        part = [F.col(f"_x{3 * i}") + (F.col(f"_x{3 * i + 1}") - F.col(f"_x{3 * i}")) * F.col(f"_x{3 * i + 2}") for i in range(len(at))]
        out[c] = got.select(*keys, F.array(*part).alias("q"))
    return out


def beside_quantiles(table: DataFrame, df: DataFrame, column: str, at: tuple[float, ...], by: list[str] | None = None) -> DataFrame:
    """A table of groups (``by``) with the column's quantiles in ``_q``, null without values."""
    q = quantiles(df, [column], at, by)[column].withColumnRenamed("q", "_q")
    if not by:
        return table.crossJoin(q) if not q.isEmpty() else table.withColumn("_q", F.lit(None).cast("array<double>"))  # one row each
    on = [F.col(b).eqNullSafe(F.col(f"_b{i}")) for i, b in enumerate(by)]
    return table.join(q, on, "left").drop(*[f"_b{i}" for i in range(len(by))])


def with_ranks(df: DataFrame, columns: dict[str, Column], values: dict[str, str] | list[str], by: list[str] | None = None) -> DataFrame:
    """Add ``columns``, expressions over <value>_before, <value>_same and <value>_total of each value column (null without a rank)."""
    by = by or []
    names = list(values)
    tables = value_ranks(df, names, by)
    taken = {f"{c}{f}" for c in names for f in ("_before", "_same", "_total", "_v")} & set(df.columns)
    aside = {c: f"_own{i}_{c}" for i, c in enumerate(sorted(taken))}  # columns of the rows that have the names of ranks
    out = df.withColumnsRenamed(aside)
    names, columns, by = [aside.get(c, c) for c in names], columns, [aside.get(b, b) for b in by]
    if any(c in aside for c in list(values)):
        raise ValueError(f"{sorted(set(values) & set(aside))}: a column is named like another one's rank")
    for c in names:
        t = tables[c].withColumnsRenamed({"_v": f"{c}_v", **{f: f"{c}{f}" for f in ("_before", "_same", "_total")}, **{f"_b{i}": f"{c}_b{i}" for i in range(len(by))}})
        on = F.col(c).cast(t.schema[f"{c}_v"].dataType) == F.col(f"{c}_v")
        for i, b in enumerate(by):
            on = on & F.col(b).eqNullSafe(F.col(f"{c}_b{i}"))
        out = out.join(t, on, "left").drop(f"{c}_v", *[f"{c}_b{i}" for i in range(len(by))])
    made = out.withColumns(columns).drop(*[f"{c}{f}" for c in names for f in ("_before", "_same", "_total")])
    return made.withColumnsRenamed({v: k for k, v in aside.items()})


def _average(c: str, ascending: bool = True) -> Column:
    up = F.col(f"{c}_before") + (F.col(f"{c}_same") + 1) / 2
    return up if ascending else F.col(f"{c}_total") + 1 - up


def _score(c: str, reverse: bool) -> Column:
    s = F.when(F.col(f"{c}_total") == 1, 1.0).otherwise((_average(c) - 1) / F.nullif(F.col(f"{c}_total") - 1, F.lit(0)))
    return F.when(F.col(f"{c}_total") > 1, 1.0 - s).otherwise(s) if reverse else s


def with_average_rank(df: DataFrame, value: str, out: str, by: list[str] | None = None, ascending: bool = True) -> DataFrame:
    """Average rank of each row by value, within groups; values that are null or not finite get none."""
    return with_ranks(df, {out: _average(value, ascending)}, [value], by)


def percentile_scores(df: DataFrame, scores: dict[str, tuple[str, bool]], by: list[str] | None = None) -> DataFrame:
    """Several scores {out: (column, reverse)}: (average rank - 1) / (n - 1), reversed one minus it; 1 for a single value either way."""
    names = list(dict.fromkeys(c for c, _ in scores.values()))
    return with_ranks(df, {out: _score(c, reverse) for out, (c, reverse) in scores.items()}, names, by)


def percentile_score(df: DataFrame, value: str, out: str, by: list[str] | None = None, reverse: bool = False) -> DataFrame:
    return percentile_scores(df, {out: (value, reverse)}, by)


def pct_rank(df: DataFrame, value: str, out: str, ascending: bool = True, by: list[str] | None = None) -> DataFrame:
    """Average rank over the number of values."""
    return with_ranks(df, {out: _average(value, ascending) / F.col(f"{value}_total")}, [value], by)


def min_rank(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Rank with ties at their lowest, highest value first."""
    return with_ranks(df, {out: (F.col(f"{value}_total") - F.col(f"{value}_before") - F.col(f"{value}_same") + 1).cast("long")}, [value], by)


def ordinal(df: DataFrame, key: str, out: str) -> DataFrame:
    """Position, from 0, of each row by a key that no other row has."""
    return with_ranks(df, {out: F.col(f"{key}_before")}, [key])


def configured_score(df: DataFrame, policy: dict, fields: dict[str, str], out: str) -> DataFrame:
    """The score of the column that a policy names: {"enabled", "adopted", "fallback"}; low values are good."""
    name = policy.get("adopted", "") if policy.get("enabled", True) else policy.get("fallback", "")
    if name not in fields:
        raise ValueError(f"no ranker {name!r}; there are {sorted(fields)}")
    return percentile_score(df, fields[name], out, reverse=True)


def leave_one_out(df: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """(omitted, winner, score): the best row by the mean of all columns but one, for each omitted column; ties to the smaller key."""
    grid = df.select(key, F.explode(F.array(*[F.struct(F.lit(o).alias("omitted"), (sum(F.col(c) for c in parts if c != o) / (len(parts) - 1)).alias("score")) for o in parts])).alias("x"))
    best = grid.groupBy("x.omitted").agg(F.min_by(F.struct(F.col(key), F.col("x.score").alias("score")), F.struct(-F.col("x.score"), F.col(key))).alias("w"))
    return best.select("omitted", F.col(f"w.{key}").alias("winner"), F.col("w.score").alias("score"))


def consensus_rank(df: DataFrame, votes: str, predictions: dict[str, int], out: str) -> DataFrame:
    """The mean of percentile scores: of the votes, high values good, and of each array column's mean, low values good.

    predictions: {array column: its size}. A row without votes, or with an array of another size or with values
    that are null or not finite, is an error.
    """
    if not predictions:
        raise ValueError("no predictions")
    sound = finite(F.col(votes))
    for c, n in predictions.items():
        sound = sound & (F.size(c) == n) & F.forall(F.col(c), lambda v: v.isNotNull() & finite(v))
    own = {f"_mean{i}": F.aggregate(F.col(c), F.lit(0.0), lambda a, v: a + v.cast("double")) / n for i, (c, n) in enumerate(predictions.items())}
    checked = df.withColumn("_votes", F.when(F.coalesce(sound, F.lit(False)), F.col(votes).cast("double")).otherwise(F.raise_error(F.lit("votes and predictions must be complete")).cast("double"))).withColumns(own)
    names = {"_p": ("_votes", False)} | {f"_p{i}": (f"_mean{i}", True) for i in range(len(predictions))}
    scored = percentile_scores(checked, names)
    return scored.withColumn(out, sum(F.col(c) for c in names) / len(names)).select(*df.columns, out)


def blend(weights: dict[str, float]) -> Column:
    """Weighted mean of the columns that have a value, over the weights of those; null if none has."""
    some = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    total, weight = F.lit(0.0), F.lit(0.0)
    for c, w in weights.items():
        total = total + F.when(some(c), F.col(c) * w).otherwise(0.0)
        weight = weight + F.when(some(c), F.lit(w)).otherwise(0.0)
    return total / F.nullif(weight, F.lit(0.0))


#: Parts of the rankers B0 to B6: (percentile score of a column, weight); a minus before a column's name reverses its score.
RANKERS = {
    "B0": {"-broad_mean": 1.0}, "B1": {"-median_log2": 1.0}, "B2": {"vote": 1.0}, "B3": {"success_mean": 1.0}, "B4": {"success_mean": 0.75, "success_tail": 0.25},
    "B5": {"success_mean": 0.60, "success_tail": 0.20, "mdr": 0.20, "disagreement": -0.15},
    "B6": {"success_mean": 0.60, "success_tail": 0.20, "mdr": 0.20, "disagreement": -0.15, "physchem_ood": -0.10, "embedding_ood": -0.05},
}


def rankers(df: DataFrame, parts: dict[str, dict[str, float]] = RANKERS) -> DataFrame:
    """Add a column for each ranker: the weighted sum of percentile scores, all ranked in one pass."""
    names = list(dict.fromkeys(c for p in parts.values() for c in p))
    scored = percentile_scores(df, {f"_s{i}": (c.lstrip("-"), c.startswith("-")) for i, c in enumerate(names)})
    made = {r: sum((F.col(f"_s{names.index(c)}") * w for c, w in p.items()), F.lit(0.0)) for r, p in parts.items()}
    return scored.withColumns(made).drop(*[f"_s{i}" for i in range(len(names))])


def selection_scores(cells: DataFrame, row: str, target: str, value: str, first_half: Column, threshold: float = 16.0) -> DataFrame:
    """(row, B0, B1, B2, balanced, tail90) of a cube: high is good. balanced: the mean of the votes of two halves of the targets."""
    from . import aggregate

    low = (F.col(value) <= threshold).cast("double")
    per = cells.groupBy(row, target).agg(F.avg(low).alias("_v"), F.first(first_half).alias("_h"))
    votes = per.groupBy(row).agg(F.avg(F.when(F.col("_h"), F.col("_v"))).alias("_a"), F.avg(F.when(~F.col("_h"), F.col("_v"))).alias("_b"))
    c = aggregate.cube(cells, row, target, value, threshold).join(votes, row)
    return c.select(row, (-F.col("broad_mean")).alias("B0"), (-F.col("median_log2")).alias("B1"), F.col("vote").alias("B2"), ((F.col("_a") + F.col("_b")) / 2).alias("balanced"), (-F.col("q90_log2")).alias("tail90"))


def activity_scores(values: Column, probabilities: Column, other: Column) -> dict[str, Column]:
    """Scores from arrays of log2 values and of probabilities by target, and another score: negative median, mean, and the average of two."""
    from . import aggregate

    median = -aggregate.tail(values, 0.5)
    mean = F.aggregate(probabilities, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(probabilities), F.lit(0))
    return {"activity": median, "joint": mean, "activity_half": (median + other) / 2}
