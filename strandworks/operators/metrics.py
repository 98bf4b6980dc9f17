"""Metrics of scores against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .rank import finite, with_average_rank, with_ranks


def auroc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Rank-sum area under the curve; null without both classes."""
    ranked = with_average_rank(df.where(F.col(label).isNotNull() & F.col(score).isNotNull()), score, "_rank")
    s = ranked.agg(F.sum(F.when(F.col(label) == 1, F.col("_rank"))).alias("r"), F.sum(F.col(label).cast("double")).alias("p"), F.count("*").alias("n"))
    return s.select(((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * (F.col("n") - F.col("p")), F.lit(0.0))).alias("auroc"))


def precision_at(df: DataFrame, score: str, label: str, key: str, k: int) -> DataFrame:
    """Share of label 1 in the k highest, over the prevalence too; null if fewer than k are scored."""
    top = df.where(F.col(score).isNotNull()).orderBy(F.col(score).desc(), key).limit(k).agg(F.avg(label).alias("_p"), F.count("*").alias("_k"))
    base = df.agg(F.avg(label).alias("_base"))
    p = F.when(F.col("_k") == k, F.col("_p"))
    return top.crossJoin(base).select(F.lit(k).alias("k"), p.alias("precision"), (p / F.nullif(F.col("_base"), F.lit(0.0))).alias("enrichment"))  # one row each


def top_fraction(df: DataFrame, group: str, score: str, label: str, key: str, fraction: float = 0.2) -> DataFrame:
    """Mean label of each group's ceil(fraction n) lowest scores, ties to the lower key; n counts rows with a finite score and a key.

    Places are counted by ranges of (score, key), so no task holds a group.
    """
    placed = with_ranks(
        df.select(group, F.col(label).alias("_y"), F.when(finite(F.col(score)) & F.col(key).isNotNull(), F.struct(F.col(score).cast("double").alias("s"), F.col(key).alias("k"))).alias("_o")),
        {"_n": F.col("_o_before"), "_all": F.col("_o_total")}, ["_o"], [group],
    )
    return placed.where(F.col("_n") < F.ceil(F.lit(fraction) * F.col("_all"))).groupBy(group).agg(F.avg("_y").alias("top_mean"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of average ranks; null if either is constant."""
    average = lambda c: F.col(f"{c}_before") + (F.col(f"{c}_same") + 1) / 2
    ranked = with_ranks(df, {"_ra": average(a), "_rb": average(b)}, [a, b])
    flat = (F.min("_ra") == F.max("_ra")) | (F.min("_rb") == F.max("_rb"))
    return ranked.agg(F.when(~flat, F.corr("_ra", "_rb")).alias("spearman"))


def regression(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    e = F.col(predicted) - F.col(truth)
    return df.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg((F.abs(e) <= 1).cast("double")).alias("within1"), F.avg((F.abs(e) <= 2).cast("double")).alias("within2"), F.corr(truth, predicted).alias("pearson"))


def brier(df: DataFrame, p: str, label: str, clip: float = 1e-15) -> DataFrame:
    q = F.least(F.greatest(F.col(p), F.lit(clip)), F.lit(1 - clip))
    return df.agg(F.avg((F.col(p) - F.col(label)) ** 2).alias("brier"), F.avg(-(F.col(label) * F.ln(q) + (1 - F.col(label)) * F.ln(1 - q))).alias("log_loss"))


def kendall(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """Kendall's tau-a in each group by a self-join of pairs within it; for groups of bounded size."""
    rows = df.select(group, F.monotonically_increasing_id().alias("_i"), F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"))
    other = rows.select(F.col(group).alias("_g"), F.col("_i").alias("_j"), F.col("_a").alias("_a2"), F.col("_b").alias("_b2"))
    pairs = rows.join(other, (F.col(group) == F.col("_g")) & (F.col("_i") < F.col("_j")))
    return pairs.groupBy(group).agg(F.avg(F.signum(F.col("_a") - F.col("_a2")) * F.signum(F.col("_b") - F.col("_b2"))).alias("tau"))


def ridge(df: DataFrame, features: list[str], target: str, penalty: float) -> list[float]:
    """Weights, then intercept, of a ridge fit: the Gram matrix is summed in Spark, (d + 1)^2 numbers are solved on the driver."""
    import numpy as np

    cols = [F.col(c).cast("double") for c in features] + [F.lit(1.0), F.col(target).cast("double")]
    d = len(cols)
    got = df.dropna(subset=[*features, target]).agg(*[F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i in range(d) for j in range(i, d)]).first()
    g = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            g[i, j] = g[j, i] = got[f"g{i}_{j}"]
    reg = penalty * np.eye(d - 1)
    reg[-1, -1] = 0.0  # the intercept is free
    return np.linalg.solve(g[:-1, :-1] + reg, g[:-1, -1]).tolist()


def logistic_score(weights: dict[str, float], bias: float) -> Column:
    """1 / (1 + exp(-(w . x + b)))."""
    return 1 / (1 + F.exp(-sum((F.col(c) * w for c, w in weights.items()), F.lit(bias))))


def calibrate(df: DataFrame, features: list[str], label: str, out: str = "probability", apply_to: DataFrame | None = None) -> DataFrame:
    """Logistic calibration fitted by Spark ML, applied to the rows themselves or to others."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    data = VectorAssembler(inputCols=features, outputCol="_x").transform(df)
    model = LogisticRegression(featuresCol="_x", labelCol=label, probabilityCol="_p", predictionCol="_y", rawPredictionCol="_r").fit(data)
    if apply_to is not None:
        data = VectorAssembler(inputCols=features, outputCol="_x").transform(apply_to)
    return model.transform(data).withColumn(out, F.get(vector_to_array("_p"), F.lit(1))).drop("_x", "_p", "_y", "_r")


def binary(df: DataFrame, p: str, label: str, key: str | None = None) -> DataFrame:
    """brier, log_loss, auroc, auprc (average precision) and, by key, the rank correlation of mean labels and mean scores.

    Average precision is summed over distinct scores, so ties count as one step.
    """
    rows = df.where(F.col(p).isNotNull() & F.col(label).isNotNull())
    plain = brier(rows, p, label, 1e-7)
    steps = rows.groupBy(F.col(p).alias("_p")).agg(F.sum(F.col(label).cast("double")).alias("_y"), F.count("*").alias("_n"))
    ahead = value_running(steps, "_p", ["_y", "_n"])
    ap = ahead.agg((F.sum(F.col("_y") * F.col("_y_up") / F.col("_n_up")) / F.nullif(F.sum("_y"), F.lit(0.0))).alias("auprc"))
    out = plain.crossJoin(auroc(rows, p, label)).crossJoin(ap)  # one row each
    if key:
        from .graph import cut

        means = cut(rows.groupBy(key).agg(F.avg(F.col(label).cast("double")).alias("_a"), F.avg(p).alias("_b")))  # ranks are joined by value: a mean worked out again may differ in its last bit
        out = out.crossJoin(spearman(means, "_a", "_b").select(F.coalesce("spearman", F.lit(0.0)).alias("spearman_by_key")))
    return out


def value_running(df: DataFrame, value: str, sums: list[str]) -> DataFrame:
    """Add <sum>_up: the sum over all rows of the value and above; values are distinct. By ranges, like the ranks."""
    from .graph import cut

    ranged = cut(df.repartitionByRange(F.col(value).desc()).withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_s{c}") for c in sums])
    before = W.partitionBy().orderBy("_part").rowsBetween(W.unboundedPreceding, 0)  # a row a range
    parts = parts.select(F.col("_part").alias("_part2"), *[(F.sum(f"_s{c}").over(before) - F.col(f"_s{c}")).alias(f"_b{c}") for c in sums])
    own = W.partitionBy("_part").orderBy(F.col(value).desc()).rowsBetween(W.unboundedPreceding, 0)
    return ranged.join(F.broadcast(parts), F.col("_part") == F.col("_part2")).select(*df.columns, *[(F.sum(c).over(own) + F.col(f"_b{c}")).alias(f"{c}_up") for c in sums])


def precision_bounds(labels: DataFrame, predictions: DataFrame, group: str, key: str, score: str, ks: tuple[int, ...] = (10, 25, 100), share: float = 0.2) -> DataFrame:
    """(group, metric, k, available, predicted, precision, prevalence, enrichment): lowest scores first, ties by key.

    labels: (group, key, lower, upper), a hit being sure where both are equal. Null precision where fewer
    than k are scored or none of the k is sure. Scores stand by group in ranges, so no group is one task.
    """
    from . import rank

    rows = labels.join(predictions.select(group, key, F.col(score).alias("_s")), [group, key], "left")
    rows = rows.withColumn("_o", F.when(rank.finite(F.col("_s")), F.struct(F.col("_s").cast("double").alias("s"), F.col(key).alias("k"))))
    base = rows.groupBy(group).agg(F.count("*").alias("available"), F.count("_o").alias("predicted"), F.avg(F.when(F.col("lower") == F.col("upper"), F.col("lower"))).alias("prevalence"))
    wanted = F.array(*[F.struct(F.lit(f"p_at_{k}").alias("metric"), F.lit(k).cast("long").alias("k")) for k in ks], F.struct(F.lit("top20pct").alias("metric"), F.ceil(F.col("available") * share).alias("k")))
    base = base.withColumn("w", F.explode(wanted)).select(group, "available", "predicted", "prevalence", "w.metric", "w.k")
    placed = rank.with_ranks(rows.where("_o IS NOT NULL").withColumn("_g", F.col(group)), {"_place": F.col("_o_before") + 1}, ["_o"], [group])
    # an inner join, whose side of a few rows a group can be sent to the rows, then means summed before the shuffle
    few = base.select(F.col(group).alias("_gg"), F.col("metric").alias("_m"), "k")
    top = placed.join(few, (F.col(group) == F.col("_gg")) & (F.col("_place") <= F.col("k"))).groupBy("_gg", "_m").agg(F.avg(F.when(F.col("lower") == F.col("upper"), F.col("lower"))).alias("_p"))
    got = base.join(top, (F.col(group) == F.col("_gg")) & (F.col("metric") == F.col("_m")), "left")
    precision = F.when(F.col("predicted") >= F.col("k"), F.col("_p"))
    return got.select(group, "metric", "k", "available", "predicted", precision.alias("precision"), "prevalence", (precision / F.nullif(F.col("prevalence"), F.lit(0.0))).alias("enrichment"))


def interval_metrics(df: DataFrame, mean: str, scale: str, lower: str, upper: str, by: str) -> DataFrame:
    """violations (share of means outside known bounds), coverage and width of the 90% interval and the normal NLL (exact rows), macro_mae over ``by``."""
    exact = F.col(lower) == F.col(upper)
    out = (F.col(mean) < F.col(lower)) | (F.col(mean) > F.col(upper))
    half = F.col(scale) * 1.6448536269514722  # the normal's 95th percentile
    d = F.col(mean) - F.col(lower)
    cells = df.groupBy(by).agg(F.avg(F.when(exact, F.abs(d))).alias("_mae"), F.count("*").alias("_n"), F.sum(F.coalesce(out, F.lit(False)).cast("long")).alias("_out"), F.count(F.when(exact, 1)).alias("_e"), F.sum(F.when(exact, (F.abs(d) <= half).cast("double"))).alias("_in"), F.sum(F.when(exact, 2 * half)).alias("_w"), F.sum(F.when(exact, 0.5 * F.ln(F.lit(6.283185307179586) * F.col(scale) * F.col(scale)) + d * d / (2 * F.col(scale) * F.col(scale)))).alias("_nll"))
    e = F.nullif(F.sum("_e"), F.lit(0))
    return cells.agg((F.sum("_out") / F.sum("_n")).alias("violations"), (F.sum("_in") / e).alias("coverage"), (F.sum("_w") / e).alias("width"), (F.sum("_nll") / e).alias("nll"), F.avg("_mae").alias("macro_mae"))


def paired_deltas(pairs: DataFrame, rows: DataFrame, key: str, truth: str, predicted: str, steps: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """(step, pairs, delta_mae, sign_accuracy) over pairs (id_a, id_b) whose true difference is at least so many steps."""
    end = lambda i, n: rows.select(F.col(key).alias(i), F.col(truth).alias(f"t{n}"), F.col(predicted).alias(f"p{n}"))
    d = pairs.join(end("id_a", 1), "id_a").join(end("id_b", 2), "id_b").select((F.col("t1") - F.col("t2")).alias("t"), (F.col("p1") - F.col("p2")).alias("p"))
    grid = d.withColumn("step", F.explode(F.array(*map(F.lit, steps)))).where(F.abs("t") >= F.col("step"))
    return grid.groupBy("step").agg(F.count("*").alias("pairs"), F.avg(F.abs(F.col("p") - F.col("t"))).alias("delta_mae"), F.avg((F.signum("p") == F.signum("t")).cast("double")).alias("sign_accuracy"))


def ranker_metrics(df: DataFrame, score: str, target: str, key: str, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """spearman (0 where undefined) and, for each k, the mean target and how many reach a half among the k highest scores, ties by key."""
    head = df.orderBy(F.col(score).desc(), key).limit(max(ks)).select(F.struct((-F.col(score)).alias("s"), F.col(key).alias("k"), F.col(target).alias("y")).alias("r"))
    listed = head.agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["y"]).alias("y"))  # the k highest
    cols = []
    for k in ks:
        first = F.slice("y", 1, k)
        cols += [(F.aggregate(first, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(first), F.lit(0))).alias(f"top_{k}_mean"), F.size(F.filter(first, lambda x: x >= 0.5)).alias(f"top_{k}_half")]
    return spearman(df, score, target).select(F.coalesce("spearman", F.lit(0.0)).alias("spearman")).crossJoin(listed.select(*cols))  # one row each


def nested_choice(table: DataFrame, outer: str, arm: str, order: list) -> DataFrame:
    """(outer, arm): of the inner results (outer, arm, metrics), the arm that stands first by the order of their means; ties to the smaller arm."""
    means = table.groupBy(outer, arm).agg(*[F.avg(c).alias(c) for c in table.columns if c not in (outer, arm, "inner")])
    return means.groupBy(outer).agg(F.min_by(arm, F.struct(*[F.col(c) if up else -F.col(c) for c, up in order], F.col(arm))).alias(arm))


def frechet(a: DataFrame, b: DataFrame, vector: str, width: int) -> float:
    """Fréchet distance of the Gaussians of two vector columns: sums in Spark, matrices of width x width on the driver."""
    import numpy as np

    def moments(df: DataFrame):
        x = [F.get(vector, F.lit(i)).cast("double") for i in range(width)]
        rows = df.where(F.col(vector).isNotNull()).select(F.posexplode(F.array(*x)).alias("i", "xi"), F.array(*x).alias("v"))
        sums = rows.groupBy("i").agg(F.count("*").alias("n"), F.sum("xi").alias("s"), *[F.sum(F.col("xi") * F.get("v", F.lit(j))).alias(f"c{j}") for j in range(width)]).orderBy("i").collect()  # width rows
        n, s = sums[0]["n"], np.array([r["s"] for r in sums])
        c = np.array([[r[f"c{j}"] for j in range(width)] for r in sums])
        return s / n, (c - np.outer(s, s) / n) / (n - 1)

    (ma, ca), (mb, cb) = moments(a), moments(b)
    w, v = np.linalg.eigh(ca)
    root = (v * np.sqrt(np.maximum(w, 0))) @ v.T
    middle = np.linalg.eigvalsh(root @ cb @ root)
    return float(((ma - mb) ** 2).sum() + np.trace(ca) + np.trace(cb) - 2 * np.sqrt(np.maximum(middle, 0)).sum())


def set_metrics(df: DataFrame, reference: DataFrame, text: str, n: int = 3) -> DataFrame:
    """count, uniqueness, novelty and the Jaccard similarity of n-grams of a set of texts to a reference set."""
    grams = lambda d: d.where(F.length(text) >= n).select(F.explode(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(F.col(text), i, n))).alias("g")).distinct()
    own = df.groupBy(text).agg(F.count("*").alias("_n")).join(reference.select(F.col(text).alias("_r")).distinct(), F.col(text) == F.col("_r"), "left")
    base = own.agg(F.sum("_n").alias("count"), (F.count("*") / F.sum("_n")).alias("uniqueness"), F.avg(F.col("_r").isNull().cast("double")).alias("novelty"))
    both = grams(df).withColumn("a", F.lit(1)).unionByName(grams(reference).withColumn("b", F.lit(1)), allowMissingColumns=True).groupBy("g").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return base.crossJoin(both.agg(F.avg((F.col("a").isNotNull() & F.col("b").isNotNull()).cast("double")).alias("ngram_jaccard")))  # one row each


def grouped_calibration(df: DataFrame, group: str, features: list[str], label: str, folds: int, seed: str, key: str) -> DataFrame:
    """Out-of-fold probabilities: groups to balanced folds, a logistic fit on the others for each fold."""
    from .graph import balanced_folds, cut

    placed = cut(df.join(balanced_folds(df, group, folds, seed).select(group, "fold"), group))
    out = None
    for k in range(folds):
        part = calibrate(placed.where(F.col("fold") != k), features, label, apply_to=placed.where(F.col("fold") == k)).select(key, "fold", "probability", label)
        out = part if out is None else out.unionByName(part)
    return out


def adopted_variant(df: DataFrame, label: str, key: str, base: str, variants: list[str]) -> DataFrame:
    """(variant, brier, spearman_by_key, adopted): of out-of-fold probability columns, which may stand in for the base.

    Eligible is a variant whose Brier score is below the base's and whose rank correlation of mean labels and mean
    probabilities by key isn't below the base's (0 where it has none); the one of the least Brier score is adopted,
    ties to the first given; none if none is eligible. Rows with a null label, key or probability count nowhere.
    """
    from .graph import cut

    names = [base, *variants]
    rows = df.select(label, key, *names).dropna()
    y = F.col(label).cast("double")
    scores = rows.agg(*[F.avg((F.col(c) - y) ** 2).alias(c) for c in names]).first()
    means = cut(rows.groupBy(key).agg(F.avg(y).alias("_y"), *[F.avg(c).alias(c) for c in names]))  # ranks are joined by value, as in binary()
    average = lambda c: F.col(f"{c}_before") + (F.col(f"{c}_same") + 1) / 2
    ranked = with_ranks(means, {f"_r{c}": average(c) for c in ["_y", *names]}, ["_y", *names])
    flat = lambda c: F.min(c) == F.max(c)
    got = ranked.agg(*[F.when(~flat("_r_y") & ~flat(f"_r{c}"), F.corr("_r_y", f"_r{c}")).alias(c) for c in names]).first()
    corr = {c: got[c] or 0.0 for c in names}
    eligible = [c for c in variants if scores[c] is not None and scores[c] < scores[base] and corr[c] >= corr[base]]
    best = min(eligible, key=lambda c: scores[c], default=None)
    return df.sparkSession.createDataFrame([(c, scores[c], corr[c], c == best) for c in names], "variant string, brier double, spearman_by_key double, adopted boolean")  # a row a variant
