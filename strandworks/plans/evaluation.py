"""Queries of metrics, aggregates over targets, and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import physchem
from ..operators import aggregate, metrics, resample, vectors
from .catalog import AVG_RANK, query, r6

#: The index a draw takes: the first fifteen hex digits of the SHA-256 of seed:round:j, modulo n.
DRAW = "(('0x' || substr(sha256({seed} || ':' || {round} || ':' || {j}), 1, 15))::BIGINT % {n})"

#: Labelled documents with their length as the score of a probability-like kind.
SCORED = "(SELECT doc_id, quality AS y, lang, length(text) / (length(text) + 1000.0) AS p FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL)"


def scored(t):
    n = F.length("text")
    return t("documents").where("text IS NOT NULL").join(t("labels"), "doc_id").select("doc_id", F.col("quality").alias("y"), "lang", (n / (n + 1000.0)).alias("p"))


@query(f"""
WITH s AS {SCORED}, c AS (SELECT *, greatest(1e-7, least(1 - 1e-7, p)) AS q FROM s), g AS (SELECT p, sum(y) AS y, count(*) AS n FROM s GROUP BY p), u AS (SELECT *, sum(y) OVER (ORDER BY p DESC) AS yu, sum(n) OVER (ORDER BY p DESC) AS nu FROM g),
r AS (SELECT y, {AVG_RANK.format(v='p')} AS r FROM s), m AS (SELECT lang, avg(y) AS a, avg(p) AS b FROM s GROUP BY lang), k AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM m)
SELECT round(avg((p - y) * (p - y)), 6) AS brier, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS log_loss, (SELECT round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) FROM r) AS auroc,
(SELECT round(sum(y * yu / nu) / sum(y), 6) FROM u) AS auprc, (SELECT round(coalesce(CASE WHEN min(ra) < max(ra) AND min(rb) < max(rb) THEN corr(ra, rb) END, 0), 6) FROM k) AS spearman_by_key FROM c
""")
def binary_metrics(t):
    m = metrics.binary(scored(t), "p", "y", "lang")
    return m.select(*[r6(c).alias(c) for c in m.columns])


@query("""
WITH l AS (SELECT o_orderstatus AS g, o_orderkey AS k, (o_custkey % 10 < 4)::INT AS lower, (o_custkey % 10 < 7)::INT AS upper, CASE WHEN o_custkey % 9 > 0 THEN o_totalprice END AS s FROM orders),
b AS (SELECT g, count(*) AS available, count(s) AS predicted, avg(lower) FILTER (lower = upper) AS prevalence FROM l GROUP BY g), w AS (SELECT *, unnest([{m: 'p_at_10', k: 10}, {m: 'p_at_25', k: 25}, {m: 'p_at_100', k: 100}, {m: 'top20pct', k: ceil(available * 0.2)::INT}]) AS x FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY s, k) AS i FROM l WHERE s IS NOT NULL), p AS (SELECT w.g, x.m AS metric, x.k, any_value(available) AS available, any_value(predicted) AS predicted, any_value(prevalence) AS prevalence, CASE WHEN any_value(predicted) >= x.k THEN avg(r.lower) FILTER (r.lower = r.upper) END AS precision FROM w LEFT JOIN r ON r.g = w.g AND r.i <= x.k GROUP BY w.g, x.m, x.k)
SELECT g, metric, k::BIGINT AS k, available, predicted, round(precision, 6) AS precision, round(prevalence, 6) AS prevalence, round(precision / nullif(prevalence, 0), 6) AS enrichment FROM p
""")
def precision_bounds(t):
    c = F.col("o_custkey") % 10
    l = t("orders").select(F.col("o_orderstatus").alias("g"), F.col("o_orderkey").alias("k"), (c < 4).cast("int").alias("lower"), (c < 7).cast("int").alias("upper"), F.when(F.col("o_custkey") % 9 > 0, F.col("o_totalprice")).alias("s"))
    m = metrics.precision_bounds(l.drop("s").withColumnRenamed("k", "key"), l.select("g", F.col("k").alias("key"), "s"), "g", "key", "s")
    return m.select("g", "metric", "k", "available", "predicted", *[r6(c).alias(c) for c in ("precision", "prevalence", "enrichment")])


@query("""
WITH r AS (SELECT l_returnflag AS g, l_quantity AS m, 4.0::DOUBLE AS s, l_extendedprice / 1500 AS lo, CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice / 1500 ELSE l_extendedprice / 1500 + 5 END AS hi FROM lineitem), e AS (SELECT *, lo = hi AS x, m - lo AS d FROM r)
SELECT round(avg((m < lo OR m > hi)::INT), 6) AS violations, round(avg((abs(d) <= 4 * 1.6448536269514722::DOUBLE)::INT) FILTER (x), 6) AS coverage, round(avg(8 * 1.6448536269514722::DOUBLE) FILTER (x), 6) AS width, round(avg(0.5 * ln(6.283185307179586::DOUBLE * 16) + d * d / 32) FILTER (x), 6) AS nll,
(SELECT round(avg(a), 6) FROM (SELECT avg(abs(d)) FILTER (x) AS a FROM e GROUP BY g)) AS macro_mae FROM e
""")
def interval_metrics(t):
    lo = F.col("l_extendedprice") / 1500
    r = t("lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("m"), F.lit(4.0).alias("s"), lo.alias("lo"), F.when(F.col("l_linenumber") % 2 == 0, lo).otherwise(lo + 5).alias("hi"))
    m = metrics.interval_metrics(r, "m", "s", "lo", "hi", "g")
    return m.select(*[r6(c).alias(c) for c in m.columns])


@query("""
WITH p AS (SELECT a.p_size - b.p_size AS t, (a.p_retailprice - b.p_retailprice) / 20 AS p FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)
SELECT s AS step, count(*) AS pairs, round(avg(abs(p - t)), 6) AS delta_mae, round(avg((sign(p) = sign(t))::INT), 6) AS sign_accuracy FROM p, (SELECT unnest([0, 1, 2]) AS s) WHERE abs(t) >= s GROUP BY s
""")
def paired_deltas(t):
    p = t("part").select("p_partkey", F.col("p_size").cast("double").alias("t"), (F.col("p_retailprice") / 20).alias("p"))
    ids = p.select(F.col("p_partkey").alias("id_a"), (F.col("p_partkey") + 1).alias("id_b"))
    return metrics.paired_deltas(ids, p, "p_partkey", "t", "p").select("step", "pairs", r6("delta_mae").alias("delta_mae"), r6("sign_accuracy").alias("sign_accuracy"))


@query("""
WITH s AS (SELECT p_partkey, p_retailprice AS a, p_size / 50.0 AS y FROM part), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS rb FROM s), o AS (SELECT y, row_number() OVER (ORDER BY a DESC, p_partkey) AS i FROM s)
SELECT (SELECT round(corr(ra, rb), 6) FROM r) AS spearman, round(avg(y) FILTER (i <= 5), 6) AS top_5_mean, count(*) FILTER (i <= 5 AND y >= 0.5)::INT AS top_5_half, round(avg(y) FILTER (i <= 10), 6) AS top_10_mean, count(*) FILTER (i <= 10 AND y >= 0.5)::INT AS top_10_half, round(avg(y) FILTER (i <= 20), 6) AS top_20_mean, count(*) FILTER (i <= 20 AND y >= 0.5)::INT AS top_20_half FROM o
""")
def ranker_metrics(t):
    p = t("part").select("p_partkey", F.col("p_retailprice").alias("a"), (F.col("p_size") / 50.0).alias("y"))
    m = metrics.ranker_metrics(p, "a", "y", "p_partkey")
    return m.select(*[(r6(c) if c.endswith(("mean", "man")) else F.col(c)).alias(c) for c in m.columns])


@query("""
WITH m AS (SELECT l_returnflag AS fold, l_linestatus AS arm, avg(abs(l_quantity - 25)) AS mae, avg((l_tax > 0.04)::INT) AS top FROM lineitem GROUP BY ALL) SELECT fold, arm FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(mae, 9), round(top, 9) DESC, arm) AS n FROM m) WHERE n = 1
""")
def nested_choice(t):
    m = t("lineitem").groupBy(F.col("l_returnflag").alias("fold"), F.col("l_linestatus").alias("arm")).agg(F.round(F.avg(F.abs(F.col("l_quantity") - 25)), 9).alias("mae"), F.round(F.avg((F.col("l_tax") > 0.04).cast("double")), 9).alias("top"))
    return metrics.nested_choice(m, "fold", "arm", [("mae", True), ("top", False)])


@query("""
WITH a AS (SELECT p_name AS s FROM part WHERE p_size < 25), b AS (SELECT DISTINCT p_name AS s FROM part WHERE p_size >= 25), ga AS (SELECT DISTINCT unnest(list_transform(range(1, length(s) - 1), lambda i: s[i:i + 2])) AS g FROM a), gb AS (SELECT DISTINCT unnest(list_transform(range(1, length(s) - 1), lambda i: s[i:i + 2])) AS g FROM b)
SELECT (SELECT count(*) FROM a) AS count, round((SELECT count(DISTINCT s) / count(*) FROM a), 6) AS uniqueness, (SELECT round(avg((s NOT IN (SELECT s FROM b))::INT), 6) FROM (SELECT DISTINCT s FROM a)) AS novelty, round((SELECT count(*) FROM (FROM ga INTERSECT FROM gb)) / (SELECT count(*) FROM (FROM ga UNION FROM gb)), 6) AS ngram_jaccard
""")
def set_metrics(t):
    p = t("part").select(F.col("p_name").alias("s"), "p_size")
    m = metrics.set_metrics(p.where("p_size < 25"), p.where("p_size >= 25"), "s")
    return m.select("count", *[r6(c).alias(c) for c in m.columns[1:]])


@query(None)
def frechet_distance(t):
    """Distance of the Gaussians of the vectors of the lowest label and of the rest, eight coordinates; tested against numpy."""
    e = t("embeddings").select(F.slice("embedding", 1, 8).alias("v"), "label")
    low = e.agg(F.min("label").alias("m")).first().m
    d = metrics.frechet(e.where(F.col("label") == low), e.where(F.col("label") != low), "v", 8)
    return t("region").limit(1).select(F.lit(round(d, 6)).alias("distance"))


@query(None)
def grouped_calibration(t):
    """Out-of-fold probabilities of quality by length, folds by source; folds and ranges are tested."""
    d = scored(t).join(t("documents").select("doc_id", "source"), "doc_id")
    return metrics.grouped_calibration(d, "source", ["p"], "y", 5, "42", "doc_id").groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg("probability"), 3).alias("mean"))


@query("SELECT l_linestatus, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std, round(quantile_cont(l_quantity, 0.1), 6) AS p10, round(quantile_cont(l_quantity, 0.5), 6) AS p50, round(quantile_cont(l_quantity, 0.9), 6) AS p90 FROM lineitem GROUP BY 1")
def five_numbers(t):
    s = aggregate.five_numbers(t("lineitem"), "l_quantity", ["l_linestatus"])
    return s.select("l_linestatus", *[r6(c).alias(c) for c in s.columns[1:]])


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding[1:11], lambda x: abs(x::DOUBLE)) AS a FROM embeddings)
SELECT vec_id, round((a[1] + a[4] + least(a[2], a[3], a[4]) + a[5] + least(a[6], a[7]) + a[9] + a[10] + a[11]) / 8, 6) AS proxy, round(list_avg(a[1:7]), 6) AS negative, round(list_avg(a[8:11]), 6) AS positive, round(list_avg(a), 6) AS mean, round(list_sort(a)[2], 6) AS tail FROM v
""")
def target_groups(t):
    a = F.transform(F.slice("embedding", 1, 11), lambda x: F.abs(x.cast("double")))
    v = t("embeddings").select("vec_id", a.alias("a"))
    m = lambda places: r6(aggregate.mean_of(F.col("a"), places))
    return v.select("vec_id", m([0, 3, (1, 2, 3), 4, (5, 6), 8, 9, 10]).alias("proxy"), m(list(range(7))).alias("negative"), m(list(range(7, 11))).alias("positive"), m(list(range(11))).alias("mean"), r6(aggregate.tail(F.col("a"), 0.1)).alias("tail"))


@query("""
WITH f AS (SELECT l_partkey, CASE WHEN l_linenumber <= 2 THEN 'a' WHEN l_linenumber <= 3 THEN 'b' WHEN l_linenumber <= 5 THEN 'c' ELSE 'd' END AS family, avg((l_quantity <= 16)::INT) AS v FROM lineitem GROUP BY ALL)
SELECT l_partkey, round(avg(v), 6) AS mean, round(list_avg(list_sort(list(v))[1:3]), 6) AS worst3 FROM f GROUP BY l_partkey
""")
def species_votes(t):
    spark = t("region").sparkSession
    families = spark.createDataFrame([(i, "a" if i <= 2 else "b" if i == 3 else "c" if i <= 5 else "d") for i in range(1, 20)], "l_linenumber int, family string")
    l = t("lineitem").withColumn("vote", (F.col("l_quantity") <= 16).cast("double")).withColumn("l_linenumber", F.col("l_linenumber").cast("int"))
    return aggregate.two_level_votes(l, "l_partkey", "l_linenumber", "vote", families).select("l_partkey", r6("mean").alias("mean"), r6("worst3").alias("worst3"))


@query("""
WITH r AS (SELECT 'l_returnflag' AS slice, l_returnflag AS value, (l_discount - l_tax) * 30 AS e, l_quantity > 25 AS c FROM lineitem UNION ALL SELECT 'l_linestatus', l_linestatus, (l_discount - l_tax) * 30, l_quantity > 25 FROM lineitem), s AS (SELECT *, 'all' AS cohort FROM r UNION ALL SELECT *, 'cohort' FROM r WHERE c)
SELECT slice, value, cohort, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg((abs(e) <= 1)::INT), 6) AS within1 FROM s GROUP BY ALL
""")
def metric_slices(t):
    m = aggregate.metric_slices(t("lineitem").withColumn("e", (F.col("l_discount") - F.col("l_tax")) * 30), ["l_returnflag", "l_linestatus"], "e", F.col("l_quantity") > 25)
    return m.select("slice", "value", "cohort", "n", r6("mae").alias("mae"), r6("rmse").alias("rmse"), r6("within1").alias("within1"))


@query("""
WITH f AS (SELECT p_brand, p_size > 40 AS big, p_retailprice > 1000 AS dear, (p_size % 2 = 0)::INT AS lo, (p_size % 3 > 0)::INT AS hi FROM part), g AS (SELECT 'big' AS removed, p_brand, (NOT dear)::INT AS ok, lo, hi FROM f UNION ALL SELECT 'dear', p_brand, (NOT big)::INT, lo, hi FROM f)
SELECT removed, p_brand, round(avg(ok) FILTER (lo = 1), 6) AS positives, round(avg(ok) FILTER (hi = 0), 6) AS negatives FROM g GROUP BY ALL
""")
def rule_retention(t):
    reasons = F.array_compact(F.array(F.when(F.col("p_size") > 40, "big"), F.when(F.col("p_retailprice") > 1000, "dear")))
    p = t("part").select("p_brand", reasons.alias("reasons"), (F.col("p_size") % 2 == 0).cast("int").alias("lo"), (F.col("p_size") % 3 > 0).cast("int").alias("hi"))
    return aggregate.retention(p, "reasons", ["big", "dear"], "p_brand", "lo", "hi").select("removed", "p_brand", r6("positives").alias("positives"), r6("negatives").alias("negatives"))


@query("SELECT round(sum(a), 6) AS total FROM (SELECT l_orderkey, min(o_totalprice) AS a FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)")
def one_cost_total(t):
    l = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return aggregate.one_cost_total(l, "l_orderkey", "o_totalprice").select(r6("total").alias("total"))


@query("SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(0.1 * l_quantity - 20 * l_tax + 0.5))), 6) AS probability FROM lineitem")
def logistic_scores(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", r6(metrics.logistic_score({"l_quantity": 0.1, "l_tax": -20.0}, 0.5)).alias("probability"))


@query("""
WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS d FROM lineitem) SELECT l_orderkey, l_linenumber, round((l_quantity - m) / d, 6) AS l_quantity FROM lineitem, s
""")
def standardised_columns(t):
    return vectors.standardise(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"]).withColumn("l_quantity", r6("l_quantity"))


@query("""
WITH a AS (SELECT x, z, y, 1.0 AS one FROM (SELECT l_quantity / 10 AS x, l_tax * 10 AS z, l_extendedprice / 10000 AS y FROM lineitem)), g AS (SELECT sum(x * x) + 1 AS xx, sum(x * z) AS xz, sum(x) AS x1, sum(z * z) + 1 AS zz, sum(z) AS z1, count(*) AS n, sum(x * y) AS xy, sum(z * y) AS zy, sum(y) AS y1 FROM a),
d AS (SELECT *, xx * (zz * n - z1 * z1) - xz * (xz * n - z1 * x1) + x1 * (xz * z1 - zz * x1) AS det FROM g)
SELECT round((xy * (zz * n - z1 * z1) - xz * (zy * n - z1 * y1) + x1 * (zy * z1 - zz * y1)) / det, 6) AS w1, round((xx * (zy * n - z1 * y1) - xy * (xz * n - z1 * x1) + x1 * (xz * y1 - zy * x1)) / det, 6) AS w2, round((xx * (zz * y1 - zy * z1) - xz * (xz * y1 - zy * x1) + xy * (xz * z1 - zz * x1)) / det, 6) AS bias FROM d
""")
def ridge_weights(t):
    rows = t("lineitem").select((F.col("l_quantity") / 10).alias("x"), (F.col("l_tax") * 10).alias("z"), (F.col("l_extendedprice") / 10000).alias("y"))
    w = metrics.ridge(rows, ["x", "z"], "y", 1.0)
    return t("region").limit(1).select(*[F.lit(round(v, 6)).alias(n) for n, v in zip(("w1", "w2", "bias"), w)])


def _bootstrap(sums: str, rounds: int, seed: int) -> str:
    """CTEs c (clusters with i, n) and d (round, i, k) over clusters given by ``sums``."""
    return f"""b AS ({sums}), c AS (SELECT *, row_number() OVER (ORDER BY g) - 1 AS i FROM b), n AS (SELECT count(*) AS n FROM b),
d AS (SELECT round, {DRAW.format(seed=f"'{seed}'", round="round", j="j", n="(SELECT n FROM n)")} AS i, count(*) AS k FROM (SELECT unnest(range(0, {rounds})) AS round), (SELECT unnest(range(0, (SELECT n FROM n))) AS j) GROUP BY ALL)"""


@query(f"""
WITH {_bootstrap("SELECT l_suppkey AS g, sum(l_quantity) AS s, count(*) AS n FROM lineitem GROUP BY 1", 50, 42)}, m AS (SELECT round, sum(k * s) / sum(k * n) AS mean FROM d JOIN c USING (i) GROUP BY round)
SELECT round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.5), 6) AS mid, round(quantile_cont(mean, 0.975), 6) AS high FROM m
""")
def cluster_bootstrap_interval(t):
    b = resample.cluster_bootstrap(t("lineitem"), "l_suppkey", "l_quantity", 50)
    return b.select(*[r6(c).alias(c) for c in b.columns])


@query(f"""
WITH {_bootstrap("SELECT s_suppkey AS g, s_suppkey % 7 - s_nationkey % 5 AS d, 1 AS n FROM supplier", 80, 7)}, m AS (SELECT round, sum(k * d) / sum(k * n)::DOUBLE AS delta FROM d JOIN c USING (i) GROUP BY round)
SELECT round(quantile_cont(delta, 0.025), 6) AS low, round(quantile_cont(delta, 0.5), 6) AS mid, round(quantile_cont(delta, 0.975), 6) AS high, round(avg((delta >= 0)::INT), 6) AS not_worse FROM m
""")
def paired_bootstrap(t):
    s = t("supplier").select("s_suppkey", (F.col("s_nationkey") % 5).alias("a"), (F.col("s_suppkey") % 7).alias("b"))
    p = resample.paired_bootstrap(s, "s_suppkey", "a", "b", 80, 7)
    return p.select(*[r6(c).alias(c) for c in p.columns])


@query(f"""
WITH r AS (SELECT l_suppkey AS g, l_returnflag AS sp, l_discount - l_tax AS d FROM lineitem), cells AS (SELECT g, sp, sum(d) AS s, count(*) AS m FROM r GROUP BY ALL), {_bootstrap("SELECT DISTINCT g FROM r", 60, 42)},
p AS (SELECT round, sp, sum(k * s) / sum(k * m) AS v FROM d JOIN c USING (i) JOIN cells USING (g) GROUP BY ALL), f AS (SELECT round, avg(v) AS v FROM p GROUP BY round HAVING count(*) = (SELECT count(DISTINCT sp) FROM r))
SELECT (SELECT round(avg(v), 6) FROM (SELECT avg(d) AS v FROM r GROUP BY sp)) AS macro, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, count(*) AS rounds FROM f
""")
def component_delta(t):
    r = t("lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_returnflag").alias("sp"), (F.col("l_discount") - F.col("l_tax")).alias("d"))
    c = resample.component_delta(r, "g", "sp", "d", 60)
    return c.select(*[r6(x).alias(x) for x in ("macro", "low", "high")], "rounds")


@query(None)
def random_panels(t):
    """Summary of means of 25 parts drawn at random, a hundred times; draws are tested."""
    p = resample.random_panels(t("part"), "p_partkey", ["p_retailprice"], 25, 100)
    return aggregate.summary(p, "p_retailprice_mean").select("n", r6("mean").alias("mean"), r6("p50").alias("p50"))


@query(None)
def random_panel_metrics(t):
    """Ten numbers of each of seven metrics over a hundred panels of 25 parts; compared with NumPy in the tests."""
    brand = F.substring("p_brand", 7, 1)
    metrics = {
        "mean_price": (F.col("p_retailprice"), "mean"), "median_price": (F.col("p_retailprice"), "median"), "large": (F.col("p_size") > 25, "mean"), "brands": (F.col("p_brand"), "distinct"),
        "all_sized": (F.col("p_size"), "mean_of_all"), "median_size": (F.col("p_size"), "median_of_all"), "first_brands": (F.when(brand == "1", F.col("p_size")), "mean_of_all"),
    }
    panels = resample.panel_metrics(t("part"), "p_partkey", metrics, 25, 100)
    s = resample.panel_summary(panels, list(metrics))
    return s.select("metric", "n", *[r6(c).alias(c) for c in ("mean", "std", "min", "p50", "max")])


@query(f"""
WITH r AS (SELECT l_suppkey AS k, (l_returnflag = 'R')::INT AS y, l_quantity / 64.0::DOUBLE AS c0, round(l_discount * 100)::DOUBLE / 16 AS c1, 0.5::DOUBLE - round(l_tax * 100)::DOUBLE / 32 AS c2, 0.25::DOUBLE + round(l_discount * 100)::DOUBLE / 64 AS c3 FROM lineitem),
v AS (SELECT 'c' || i AS variant, k, y, [c0, c1, c2, c3][i + 1] AS p FROM r, range(4) t(i)), m AS (SELECT variant, k, avg(y) AS y, avg(p) AS p FROM v GROUP BY ALL),
a AS (SELECT variant, (rank() OVER (PARTITION BY variant ORDER BY y) + (count(*) OVER (PARTITION BY variant, y) - 1) / 2.0) AS ry, (rank() OVER (PARTITION BY variant ORDER BY p) + (count(*) OVER (PARTITION BY variant, p) - 1) / 2.0) AS rp FROM m),
s AS (SELECT variant, b, c FROM (SELECT variant, avg((p - y) ** 2) AS b FROM v GROUP BY 1) JOIN (SELECT variant, coalesce(corr(ry, rp), 0) AS c FROM a GROUP BY 1) USING (variant)),
e AS (SELECT variant FROM s WHERE variant <> 'c0' AND b < (SELECT b FROM s WHERE variant = 'c0') AND c >= (SELECT c FROM s WHERE variant = 'c0') ORDER BY b LIMIT 1)
SELECT variant, round(b, 6) AS brier, round(c, 6) AS spearman_by_key, variant IN (SELECT variant FROM e) AS adopted FROM s
""")
def adopted_calibration(t):
    """Which of three probabilities of a return may stand in for a plain one."""
    cents = lambda c: F.round(F.col(c) * 100)
    l = t("lineitem").select("l_suppkey", (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") / 64).alias("c0"), (cents("l_discount") / 16).alias("c1"), (0.5 - cents("l_tax") / 32).alias("c2"), (0.25 + cents("l_discount") / 64).alias("c3"))
    got = metrics.adopted_variant(l, "y", "l_suppkey", "c0", ["c1", "c2", "c3"])
    return got.select("variant", r6("brier").alias("brier"), r6("spearman_by_key").alias("spearman_by_key"), "adopted")


@query(None)
def scenario_expectations(t):
    """Hits of ten suppliers drawn at random in a line-number scenario; limits are tested."""
    hits = t("lineitem").groupBy(F.col("l_linenumber").alias("sc"), F.col("l_suppkey").alias("k")).agg(F.max((F.col("l_quantity") > 48).cast("int")).alias("hit"))
    s = resample.scenario_expectations(hits, "sc", "k", "hit", 10, 50)
    return s.select(*[r6(c).alias(c) for c in s.columns])


@query(None)
def error_trials(t):
    """Median over trials of prices with errors drawn from a residual table; batch invariance is tested."""
    e = resample.error_trials(t("part").select("p_partkey", "p_retailprice", "p_brand"), "p_partkey", "p_retailprice", [-5.0, -1.0, 0.0, 2.0, 4.0], 20, 3, "p_brand", 0.3)
    return e.groupBy("p_partkey").agg(r6(F.percentile("value", 0.5)).alias("median"))


@query("SELECT p_partkey, length(p_name)::INT AS n, array_to_string(list_sort(string_split(p_name, '')), '') AS letters FROM part")
def shuffled_letters(t):
    s = t("part").select("p_partkey", resample.shuffled(F.col("p_name"), 5).alias("s"))
    return s.select("p_partkey", F.length("s").alias("n"), F.array_join(F.array_sort(F.filter(F.split("s", ""), lambda c: c != "")), "").alias("letters"))


@query("SELECT length, count(*) AS n, 8.0::DOUBLE - length % 2 AS width FROM (SELECT unnest([8, 8, 9, 9, 9]) AS length) GROUP BY length")
def stand_in_sequences(t):
    s = resample.stand_in_sequences(t("region").sparkSession, {8: 2, 9: 3}, 1)
    ok = s.where(f"sequence RLIKE '^[{''.join(physchem.EISENBERG)}]+$' AND length(sequence) = length")
    return ok.groupBy("length").agg(F.count("*").alias("n")).withColumn("width", 8.0 - F.col("length") % 2)


_PCT = "({r} - 1) / (count(*) OVER () - 1)"


def _score(column: str) -> str:
    return _PCT.format(r=AVG_RANK.format(v=column))


@query(f"""
WITH o AS (SELECT o_orderkey, o_totalprice AS a, o_custkey AS b, o_orderkey % 1000 AS c, o_orderkey % 77 AS d FROM orders), s AS (SELECT o_orderkey, {_score('a')} AS a, {_score('b')} AS b, {_score('c')} AS c, {_score('d')} AS d FROM o)
SELECT o_orderkey, round(1 - a, 6) AS "B0", round(1 - b, 6) AS "B1", round(c, 6) AS "B2", round(d, 6) AS "B3", round(0.75 * d + 0.25 * c, 6) AS "B4", round(0.6 * d + 0.2 * c + 0.2 * a - 0.15 * b, 6) AS "B5", round(0.6 * d + 0.2 * c + 0.2 * a - 0.15 * b - 0.1 * c - 0.05 * d, 6) AS "B6" FROM s
""")
def seven_rankers(t):
    from ..operators import rank

    k = F.col("o_orderkey")
    o = t("orders").select("o_orderkey", F.col("o_totalprice").alias("broad_mean"), F.col("o_custkey").alias("median_log2"), (k % 1000).alias("vote"), (k % 77).alias("success_mean"), (k % 1000).alias("success_tail"), F.col("o_totalprice").alias("mdr"), F.col("o_custkey").alias("disagreement"), (k % 1000).alias("physchem_ood"), (k % 77).alias("embedding_ood"))
    return rank.rankers(o).select("o_orderkey", *[r6(f"B{i}").alias(f"B{i}") for i in range(7)])


@query("""
WITH t AS (SELECT l_partkey, l_linenumber AS g, avg(l_quantity) AS m, avg((l_quantity <= 16)::INT) AS v FROM lineitem GROUP BY ALL)
SELECT l_partkey, round(-avg(m), 6) AS "B0", round(-quantile_cont(log2(m), 0.5), 6) AS "B1", round(avg(v), 6) AS "B2", round((avg(v) FILTER (g <= 3) + avg(v) FILTER (g > 3)) / 2, 6) AS balanced, round(-quantile_cont(log2(m), 0.9), 6) AS tail90 FROM t GROUP BY l_partkey
""")
def selection_scores(t):
    from ..operators import rank

    s = rank.selection_scores(t("lineitem"), "l_partkey", "l_linenumber", "l_quantity", F.col("l_linenumber") <= 3)
    return s.select("l_partkey", *[r6(c).alias(c) for c in s.columns[1:]])


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding[1:7], lambda x: x::DOUBLE) AS a FROM embeddings) SELECT vec_id, round(-list_sort(a)[4], 6) AS activity, round(list_avg(a), 6) AS joint, round((-list_sort(a)[4] + a[1]) / 2, 6) AS activity_half FROM v
""")
def activity_scores(t):
    from ..operators import rank

    a = F.transform(F.slice("embedding", 1, 7), lambda x: x.cast("double"))
    v = t("embeddings").select("vec_id", a.alias("a"))
    return v.select("vec_id", *[r6(c).alias(n) for n, c in rank.activity_scores(F.col("a"), F.col("a"), F.get("a", F.lit(0))).items()])


@query(None)
def nested_folds(t):
    """Suppliers joined by the orders that they share, as a share of the fewer orders of the two, and by nations: outer folds and inner ones; tested by hand."""
    from ..operators import graph

    s = t("supplier").select(F.col("s_suppkey").alias("id"))
    sold = t("lineitem").select("l_orderkey", F.col("l_suppkey").alias("id")).distinct()
    of = sold.groupBy("id").agg(F.count("*").alias("n"))
    both = sold.withColumnRenamed("id", "id_a").join(sold.withColumnRenamed("id", "id_b"), "l_orderkey").where("id_a < id_b").groupBy("id_a", "id_b").agg(F.count("*").alias("n"))
    pairs = both.join(of.select(F.col("id").alias("id_a"), F.col("n").alias("na")), "id_a").join(of.select(F.col("id").alias("id_b"), F.col("n").alias("nb")), "id_b").select("id_a", "id_b", (F.col("n") / F.least("na", "nb")).alias("ratio"))
    return graph.nested_folds(s.distinct(), pairs, t("supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 97 * 100 + F.col("s_nationkey")).alias("key")), 0.6, 3, 2, "42")
