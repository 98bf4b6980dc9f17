"""Queries on the driver tables and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import censor, seq
from ..operators import aggregate, graph, joins, metrics, quota, rank, resample, select, vectors
from ..streaming import events as stream
from . import evaluation, features, fits, measurements, selection  # noqa: F401  they register theirs
from .catalog import AVG_RANK, FLAGSHIP, ORACLES, QUERIES, query, r6

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]

LOWER = "abcdefghijklmnopqrstuvwxyz"
#: The sequence of a document: all its Latin letters; valid from LOW to HIGH of them.
SEQ_SQL = "lower(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'))"
LOW, HIGH = 8, 2000


def seq_col(text="text"):
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", ""))


@query(f"""
WITH d AS (SELECT doc_id, source, {SEQ_SQL} AS s FROM documents),
m AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id) AS nth, length(s) BETWEEN {LOW} AND {HIGH} AS ok, s IN (SELECT {SEQ_SQL} FROM benchmark) AS known FROM d)
SELECT doc_id, CASE WHEN NOT ok THEN 'invalid' WHEN nth > 1 THEN 'duplicate' WHEN known THEN 'reference_overlap' END AS reason FROM m
""")
def reject_all_seen(t):
    docs = t("documents").select("doc_id", seq_col().alias("s"))
    return select.mark_all_seen(docs, t("benchmark").select(seq_col().alias("s")), "s", "doc_id", seq.alphabet_ok(F.col("s"), LOW, HIGH, LOWER)).select("doc_id", "reason")


@query(f"""
WITH d AS (SELECT doc_id, source, {SEQ_SQL} AS s FROM documents),
m AS (SELECT *, length(s) BETWEEN {LOW} AND {HIGH} AS ok, s IN (SELECT {SEQ_SQL} FROM benchmark) AS known FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY s, ok AND NOT known ORDER BY doc_id) AS nth FROM m),
r AS (SELECT source, CASE WHEN NOT ok THEN 'invalid' WHEN known THEN 'reference_overlap' WHEN nth > 1 THEN 'duplicate' ELSE 'accepted' END AS reason FROM n)
SELECT source, reason, count(*) AS n FROM r GROUP BY ALL
""")
def reject_accepted_seen_inventory(t):
    docs = t("documents").select("doc_id", "source", seq_col().alias("s"))
    marked = select.mark_accepted_seen(docs, t("benchmark").select(seq_col().alias("s")), "s", "doc_id", seq.alphabet_ok(F.col("s"), LOW, HIGH, LOWER))
    return marked.groupBy("source", F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""
WITH d AS (SELECT doc_id, {SEQ_SQL} AS s FROM documents),
c AS (SELECT doc_id, s, length(s) AS n, unnest(string_split(s, '')) AS c FROM d WHERE s <> ''),
g AS (SELECT doc_id, n, c, count(*) AS k FROM c GROUP BY ALL)
SELECT doc_id, any_value(n)::INT AS n, round(-sum(k / n::DOUBLE * log2(k / n::DOUBLE)), 6) AS entropy, round(max(k) / any_value(n)::DOUBLE, 6) AS max_share FROM g GROUP BY doc_id
""")
def sequence_features(t):
    s = F.col("s")
    d = t("documents").select("doc_id", seq_col().alias("s")).where("s <> ''")
    return d.select("doc_id", F.length(s).alias("n"), r6(seq.entropy(s, LOWER)).alias("entropy"), r6(seq.max_share(s, LOWER)).alias("max_share"))


@query("""
WITH c AS (SELECT p_partkey, i, p_name[i] AS c FROM (SELECT p_partkey, p_name, unnest(range(1, length(p_name) + 1)) AS i FROM part)),
g AS (SELECT *, i - row_number() OVER (PARTITION BY p_partkey, c ORDER BY i) AS island FROM c),
r AS (SELECT p_partkey, c, island, count(*) AS n FROM g GROUP BY ALL)
SELECT p.p_partkey, max(r.n)::INT AS longest_run,
  list_max(list_transform(regexp_split_to_array(any_value(p.p_name), '[aeiou]'), lambda x: length(x)))::INT AS clean_stretch,
  (len(regexp_extract_all(any_value(p.p_name), '[aeiou][^aeiou]')) + len(regexp_extract_all(any_value(p.p_name), 'r')))::INT AS motifs
FROM part p JOIN r USING (p_partkey) GROUP BY p.p_partkey
""")
def runs_and_motifs(t):
    s = F.col("p_name")
    return t("part").where("p_name <> ''").select("p_partkey", seq.longest_run(s).alias("longest_run"), seq.longest_stretch_without(s, "aeiou").alias("clean_stretch"), seq.motif_count(s, "[aeiou][^aeiou]", "r").alias("motifs"))


@query(f"""
SELECT o_orderkey, round(CASE WHEN count(*) OVER () = 1 THEN 1.0 ELSE ({AVG_RANK.format(v='o_totalprice')} - 1) / nullif(count(*) OVER () - 1, 0) END, 9) AS score FROM orders
""")
def percentile_score_orders(t):
    return rank.percentile_score(t("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "score").select("o_orderkey", F.round("score", 9).alias("score"))


@query("""
WITH r AS (SELECT p_partkey, p_brand, p_size, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_partkey, round(CASE WHEN n = 1 THEN 1.0 ELSE 1.0 - (r - 1) / nullif(n - 1, 0) END, 9) AS score FROM r
""")
def percentile_score_reversed_by_group(t):
    return rank.percentile_score(t("part").select("p_partkey", "p_brand", "p_size"), "p_size", "score", ["p_brand"], reverse=True).select("p_partkey", F.round("score", 9).alias("score"))


@query(f"""
SELECT p_partkey, round({AVG_RANK.format(v='p_size DESC').replace('PARTITION BY p_size DESC', 'PARTITION BY p_size')} / count(*) OVER (), 9) AS pct, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC)::INT AS min_rank FROM part
""")
def pct_and_min_rank(t):
    p = rank.pct_rank(t("part").select("p_partkey", "p_size", "p_brand", "p_retailprice"), "p_size", "pct", ascending=False)
    p = rank.min_rank(p, "p_retailprice", "min_rank", ["p_brand"])
    return p.select("p_partkey", F.round("pct", 9).alias("pct"), F.col("min_rank").cast("int").alias("min_rank"))


@query(f"""
WITH r AS (SELECT p_partkey, ({AVG_RANK.format(v='p_size')} - 1) / nullif(count(*) OVER () - 1, 0) AS a, 1 - ({AVG_RANK.format(v='p_retailprice')} - 1) / nullif(count(*) OVER () - 1, 0) AS b FROM part)
SELECT p_partkey, round((0.7 * a + 0.3 * b) / 1.0, 9) AS quality, CASE WHEN a >= 0.5 THEN 1 ELSE 0 END AS upper_half FROM r
""")
def consensus_quality(t):
    p = rank.percentile_scores(t("part").select("p_partkey", "p_size", "p_retailprice"), {"a": ("p_size", False), "b": ("p_retailprice", True)})
    return p.select("p_partkey", F.round(rank.blend({"a": 0.7, "b": 0.3}), 9).alias("quality"), F.when(F.col("a") >= 0.5, 1).otherwise(0).alias("upper_half"))


@query("""
SELECT p_partkey, p_size, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice, p_partkey) AS n FROM part) WHERE n <= 3
""")
def quota_top_per_group(t):
    return select.top_per_group(t("part"), "p_size", [F.col("p_retailprice"), F.col("p_partkey")], 3).select("p_partkey", "p_size", "p_brand")


@query("""
WITH a AS (SELECT *, row_number() OVER (PARTITION BY p_size, p_brand ORDER BY p_retailprice, p_partkey) AS turn FROM part),
b AS (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY turn, p_brand) AS n FROM a)
SELECT p_partkey, p_size, p_brand FROM b WHERE n <= 5
""")
def quota_round_robin(t):
    return select.round_robin(t("part"), "p_size", "p_brand", [F.col("p_retailprice"), F.col("p_partkey")], 5).select("p_partkey", "p_size", "p_brand")


@query("""
WITH c AS (SELECT p_size, count(*) AS n FROM part GROUP BY p_size), e AS (SELECT p_size, n * 1000 / (SELECT sum(n) FROM c)::DOUBLE AS x FROM c),
f AS (SELECT p_size, floor(x) AS fl, row_number() OVER (ORDER BY x - floor(x) DESC, p_size) AS k, 1000 - sum(floor(x)) OVER () AS rest FROM e)
SELECT p_size, (fl + CASE WHEN k <= rest THEN 1 ELSE 0 END)::BIGINT AS quota FROM f
""")
def largest_remainder_quotas(t):
    counts = t("part").groupBy("p_size").agg(F.count("*").cast("double").alias("w"))
    return quota.largest_remainder(counts, "p_size", "w", 1000)


@query("SELECT doc_id, CASE WHEN b < 0.70 THEN 'train' WHEN b < 0.85 THEN 'development' ELSE 'holdout' END AS part FROM (SELECT doc_id, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 AS b FROM documents)")
def hash_split(t):
    return t("documents").select("doc_id", seq.hash_split(F.col("doc_id").cast("string")).alias("part"))


@query("SELECT doc_id FROM documents ORDER BY sha256('42:' || doc_id), doc_id LIMIT 50")
def nested_subset(t):
    return select.nested_subset(t("documents").select("doc_id"), "doc_id", "42", 50)


@query("""
WITH t AS (SELECT l_orderkey, l_linenumber % 3 AS g, avg(l_quantity) AS m, avg(CASE WHEN l_quantity <= 16 THEN 1.0 ELSE 0.0 END) AS s FROM lineitem GROUP BY ALL),
a AS (SELECT l_orderkey, avg(m) AS broad_mean, avg(s) AS vote, quantile_cont(log2(m), 0.5) AS med, quantile_cont(log2(m), 0.9) AS q90, list_reverse_sort(list(log2(m)))[1:3] AS w FROM t GROUP BY l_orderkey),
d AS (SELECT l_orderkey, quantile_cont(log2(l_quantity), 0.5) AS mid FROM lineitem GROUP BY l_orderkey),
e AS (SELECT l.l_orderkey, quantile_cont(abs(log2(l_quantity) - mid), 0.5) AS mad FROM lineitem l JOIN d USING (l_orderkey) GROUP BY l.l_orderkey)
SELECT l_orderkey, round(broad_mean, 6) AS broad_mean, round(vote, 6) AS vote, round(med, 6) AS median_log2, round(q90, 6) AS q90_log2, round(list_avg(w), 6) AS worst3_log2, round(mad, 6) AS mad_log2 FROM a JOIN e USING (l_orderkey)
""")
def cube_reductions(t):
    rows = t("lineitem").select("l_orderkey", (F.col("l_linenumber") % 3).alias("g"), "l_quantity")
    c = aggregate.cube(rows, "l_orderkey", "g", "l_quantity")
    return c.select("l_orderkey", *[r6(n).alias(n) for n in ("broad_mean", "vote", "median_log2", "q90_log2", "worst3_log2", "mad_log2")])


@query("""
SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.25), 6) AS p25,
round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS max FROM events GROUP BY event_type
""")
def numeric_summary(t):
    s = aggregate.summary(t("events"), "value", ["event_type"])
    return s.select("event_type", "n", *[r6(c).alias(c) for c in s.columns[2:]])


@query("SELECT user_id, event_type, count(*) AS n, count(value) AS n_values, count(DISTINCT CAST(ts AS DATE)) AS n_days, sum(CASE WHEN value > 10 THEN 1 ELSE 0 END)::BIGINT AS n_high FROM events GROUP BY ALL")
def grouped_inventory(t):
    return t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count("value").alias("n_values"), F.countDistinct(F.to_date("ts")).alias("n_days"), F.sum(F.when(F.col("value") > 10, 1).otherwise(0)).alias("n_high"))


@query("WITH a AS (SELECT l_linestatus, l_suppkey, avg(l_quantity) AS m FROM lineitem GROUP BY ALL) SELECT l_linestatus, round(avg(m), 6) AS macro_mean FROM a GROUP BY l_linestatus")
def macro_mean(t):
    return aggregate.macro_mean(t("lineitem"), ["l_linestatus", "l_suppkey"], F.col("l_quantity"), "m").select("l_linestatus", r6("m").alias("macro_mean"))


@query("SELECT l_partkey, min(l_quantity) AS lower, max(l_extendedprice) AS upper, count(*) AS assays FROM (SELECT DISTINCT l_partkey, l_quantity, l_extendedprice, l_discount FROM lineitem) GROUP BY l_partkey")
def bound_aggregate(t):
    return t("lineitem").select("l_partkey", "l_quantity", "l_extendedprice", "l_discount").distinct().groupBy("l_partkey").agg(F.min("l_quantity").alias("lower"), F.max("l_extendedprice").alias("upper"), F.count("*").alias("assays"))


@query("""
WITH a AS (SELECT l_linestatus AS k, count(*) / (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R')::DOUBLE AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
b AS (SELECT l_linestatus AS k, count(*) / (SELECT count(*) FROM lineitem WHERE l_returnflag <> 'R')::DOUBLE AS s FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
SELECT round(sum(abs(coalesce(a.s, 0) - coalesce(b.s, 0))) / 2, 9) AS distance FROM a FULL JOIN b ON a.k = b.k
""")
def total_variation(t):
    l = t("lineitem")
    return aggregate.total_variation(l.where("l_returnflag = 'R'"), l.where("l_returnflag <> 'R'"), "l_linestatus").select(F.round("distance", 9).alias("distance"))


@query("WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) SELECT o_custkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS k FROM c) WHERE k = 1")
def mode_vote(t):
    return aggregate.mode(t("orders"), "o_custkey", "o_orderpriority")


@query("""
WITH c AS (SELECT l_returnflag AS run, l_linenumber AS k, avg(l_quantity) AS m FROM lineitem GROUP BY ALL), g AS (SELECT k FROM c GROUP BY k HAVING count(*) = (SELECT count(DISTINCT run) FROM c)),
w AS (SELECT l_linenumber AS k, count(*) AS w FROM lineitem WHERE l_linenumber IN (SELECT k FROM g) GROUP BY 1)
SELECT run AS l_returnflag, round(sum(m * w) / sum(w), 6) AS mean FROM c JOIN w USING (k) GROUP BY run
""")
def direct_standardisation(t):
    l = t("lineitem").select("l_returnflag", "l_linenumber", F.col("l_quantity").alias("v"))
    return aggregate.standardised(l, "l_returnflag", "l_linenumber", "v", l).select("l_returnflag", r6("v").alias("mean"))


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def validated_joins(t):
    c = t("customer").withColumnRenamed("c_custkey", "o_custkey")
    out = joins.join_many_to_one(t("orders"), c, ["o_custkey"])
    return joins.join_many_to_one(out, t("nation").withColumnRenamed("n_nationkey", "c_nationkey"), ["c_nationkey"]).select("o_orderkey", "c_name", "n_name")


@query("SELECT d.doc_id, quality, l.doc_id IS NOT NULL AS present FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_join_with_presence(t):
    return joins.join_with_presence(t("documents").select("doc_id"), joins.require_unique(t("labels"), ["doc_id"]), ["doc_id"]).select("doc_id", "quality", "present")


@query("SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'with' ELSE 'without' END AS orders FROM customer")
def semi_and_anti_join(t):
    c, o = t("customer").select("c_custkey"), t("orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("orders", F.lit("with")).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("orders", F.lit("without")))


@query(None)
def similar_names(t):
    """Self-join of distinct part names (each by its smallest key) by LCS ratio; a brute-force test stands for SQL."""
    names = t("part").groupBy("p_name").agg(F.min("p_partkey").alias("id"))
    return joins.similar_pairs(names, names, "p_name", 0.8, itself=True)


@query(None)
def max_similarity_to_reference(t):
    """Highest LCS ratio of whole documents to whole benchmark texts; tested by brute force."""
    whole = lambda df, i: df.select(F.col(i).alias("id"), F.col("text").alias("s"))
    return joins.max_similarity(whole(t("documents"), "doc_id"), whole(t("benchmark"), "item_id"), "s", "id")


@query(None)
def components_of_orders(t):
    """Parts linked by standing in one order, over all rows; the recursion is too slow as SQL, a brute-force test stands for it."""
    l = t("lineitem").select("l_orderkey", "l_partkey")
    low = l.groupBy("l_orderkey").agg(F.min("l_partkey").alias("b"))  # a star an order spans what all its pairs would
    return graph.components(l.select(F.col("l_partkey").alias("id")), l.join(low, "l_orderkey").select(F.col("l_partkey").alias("a"), "b"))


@query("SELECT s_suppkey, ((dense_rank() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) % 5)::INT AS fold FROM supplier")
def stratified_folds(t):
    return graph.round_robin_folds(t("supplier"), "s_nationkey", "s_suppkey", 5).select("s_suppkey", F.col("fold").cast("int").alias("fold"))


@query("""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), r AS (SELECT e FROM v WHERE label = (SELECT min(label) FROM v)),
d AS (SELECT v.vec_id, list_distance(v.e, r.e) AS d FROM v, r), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS n FROM d)
SELECT vec_id, round(quantile_cont(d, 0.5), 4) AS distance FROM k WHERE n <= 5 GROUP BY vec_id
""")
def knn_distance(t):
    e = t("embeddings")
    low = e.agg(F.min("label").alias("_l"))
    return vectors.knn_median(e, e.join(F.broadcast(low), F.col("label") == F.col("_l")), "vec_id", "embedding").select("vec_id", F.round("distance", 4).alias("distance"))


@query(None)
def pca_and_clusters(t):
    """Row counts of k-means clusters over eight principal axes; invariants are tested."""
    p = vectors.pca(t("embeddings"), "embedding", 8)
    return vectors.kmeans(p, "projected", 8).groupBy("cluster").agg(F.count("*").alias("n"))


@query(f"""
WITH s AS (SELECT toxic, length(text) AS x FROM documents JOIN labels USING (doc_id)), r AS (SELECT toxic, {AVG_RANK.format(v='x')} AS r FROM s)
SELECT round((sum(r) FILTER (toxic = 1) - sum(toxic) * (sum(toxic) + 1) / 2.0) / nullif(sum(toxic) * (count(*) - sum(toxic)), 0), 9) AS auroc FROM r
""")
def auroc_of_length(t):
    d = t("documents").select("doc_id", F.length("text").alias("x")).join(t("labels"), "doc_id")
    return metrics.auroc(d, "x", "toxic").select(F.round("auroc", 9).alias("auroc"))


@query("""
WITH s AS (SELECT doc_id, quality, length(text) AS x FROM documents JOIN labels USING (doc_id)), k AS (SELECT avg(quality) AS p FROM (SELECT quality FROM s ORDER BY x DESC, doc_id LIMIT 25))
SELECT 25 AS k, round(p, 9) AS precision, round(p / (SELECT avg(quality) FROM s), 9) AS enrichment FROM k
""")
def precision_at_25(t):
    d = t("documents").select("doc_id", F.length("text").alias("x")).join(t("labels"), "doc_id")
    return metrics.precision_at(d, "x", "quality", "doc_id", 25).select("k", F.round("precision", 9).alias("precision"), F.round("enrichment", 9).alias("enrichment"))


@query("""
WITH s AS (SELECT l.*, row_number() OVER (PARTITION BY l_linestatus ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS n, count(*) OVER (PARTITION BY l_linestatus) AS c FROM lineitem l)
SELECT l_linestatus, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 9) AS top_mean FROM s WHERE n <= ceil(0.2 * c) GROUP BY l_linestatus
""")
def top_fraction_precision(t):
    l = t("lineitem").select("l_linestatus", F.col("l_extendedprice").alias("x"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"), F.struct("l_orderkey", "l_linenumber").alias("k"))
    return metrics.top_fraction(l, "l_linestatus", "x", "y", "k").select("l_linestatus", F.round("top_mean", 9).alias("top_mean"))


@query("""
WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part)
SELECT round(corr(a, b), 6) AS spearman FROM r
""")
def spearman_rank(t):
    return metrics.spearman(t("part").select("p_size", "p_retailprice"), "p_size", "p_retailprice").select(r6("spearman").alias("spearman"))


@query("""
SELECT round(avg(abs(d)), 6) AS mae, round(sqrt(avg(d * d)), 6) AS rmse, round(avg((abs(d) <= 1)::INT), 6) AS within1, round(avg((abs(d) <= 2)::INT), 6) AS within2, round(corr(l_quantity, p), 6) AS pearson
FROM (SELECT l_quantity, l_extendedprice / 1500 AS p, l_extendedprice / 1500 - l_quantity AS d FROM lineitem)
""")
def regression_metrics(t):
    m = metrics.regression(t("lineitem").withColumn("p", F.col("l_extendedprice") / 1500), "l_quantity", "p")
    return m.select(*[r6(c).alias(c) for c in m.columns])


@query("SELECT p_partkey, p_size, p_retailprice FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_size >= p.p_size AND q.p_retailprice <= p.p_retailprice AND (q.p_size > p.p_size OR q.p_retailprice < p.p_retailprice))")
def pareto_front(t):
    return select.pareto_front(t("part"), {"p_size": True, "p_retailprice": False}).select("p_partkey", "p_size", "p_retailprice")


@query("""
WITH p AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '>' WHEN 1 THEN '<=' WHEN 2 THEN '' WHEN 3 THEN '≥' ELSE '~' END AS r, round(value, 2) AS v FROM events)
SELECT event_id, CASE WHEN r = '~' OR v IS NULL OR v <= 0 THEN NULL WHEN r = '' THEN '=' WHEN r = '≥' THEN '>=' ELSE r END AS relation, CASE WHEN r <> '~' AND v > 0 THEN v END AS value,
CASE WHEN r = '~' OR v IS NULL OR v <= 0 THEN NULL WHEN r IN ('', '<=') AND v <= 16 THEN 1 WHEN (r = '' AND v > 16) OR (r = '>' AND v >= 16) OR (r = '≥' AND v > 16) THEN 0 END AS label FROM p
""")
def censored_labels(t):
    sign = F.element_at(F.array(*[F.lit(x) for x in (">", "<=", "", "≥", "~")]), (F.col("event_id") % 5 + 1).cast("int"))
    e = t("events").select("event_id", F.round("value", 2).alias("v"), censor.parse(F.concat(F.lit(" "), sign, F.lit(" "), F.round("value", 2).cast("decimal(20,2)").cast("string"))).alias("p"))
    return e.select("event_id", "p.relation", F.col("p.value").alias("value"), censor.label(F.col("p.relation"), F.col("p.value")).alias("label"))


@query("SELECT conv_id, max(CASE WHEN role = 'system' THEN n END) AS system, max(CASE WHEN role = 'user' THEN n END) AS \"user\", max(CASE WHEN role = 'assistant' THEN n END) AS assistant FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL) GROUP BY conv_id")
def pivot_roles(t):
    return t("conversations").groupBy("conv_id").pivot("role", ["system", "user", "assistant"]).agg(F.count(F.lit(1))).select("conv_id", *[F.nullif(F.coalesce(c, F.lit(0)), F.lit(0)).alias(c) for c in ("system", "user", "assistant")])


@query("SELECT p_partkey, 'p_size' AS field, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def unpivot_parts(t):
    p = t("part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return p.unpivot("p_partkey", ["p_size", "p_retailprice"], "field", "value")


@query("SELECT CASE WHEN l_quantity <= 10 THEN '(0,10]' WHEN l_quantity <= 25 THEN '(10,25]' WHEN l_quantity <= 50 THEN '(25,50]' END AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def right_closed_bins(t):
    q = F.col("l_quantity")
    return t("lineitem").groupBy(F.when(q <= 10, "(0,10]").when(q <= 25, "(10,25]").when(q <= 50, "(25,50]").alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT word, count(*) AS n, count(DISTINCT p_partkey) AS parts FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word")
def exploded_words(t):
    return t("part").select("p_partkey", F.explode_outer(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("p_partkey").alias("parts"))


@query("""
WITH a AS (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 100), b AS (SELECT p_partkey FROM part ORDER BY p_size DESC, p_partkey LIMIT 100)
SELECT (SELECT count(*) FROM a SEMI JOIN b USING (p_partkey)) AS both_sets, (SELECT count(*) FROM (FROM a UNION FROM b)) AS either, (SELECT count(*) FROM a ANTI JOIN b USING (p_partkey)) AS only_a
""")
def top_set_overlap(t):
    p = t("part")
    a = p.orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(100).select("p_partkey")
    b = p.orderBy(F.col("p_size").desc(), "p_partkey").limit(100).select("p_partkey")
    both = a.withColumn("a", F.lit(1)).unionByName(b.withColumn("b", F.lit(1)), allowMissingColumns=True).groupBy("p_partkey").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return both.agg(F.count_if(F.expr("a = 1 AND b = 1")).alias("both_sets"), F.count("*").alias("either"), F.count_if(F.expr("a = 1 AND b IS NULL")).alias("only_a"))


@query("SELECT user_id, event_id, lead(event_id) OVER w AS next_event, row_number() OVER w > 1 AS repeated FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def consecutive_pairs(t):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return t("events").select("user_id", "event_id", F.lead("event_id").over(w).alias("next_event"), (F.row_number().over(w) > 1).alias("repeated"))


@query("""
WITH f AS (SELECT p_partkey, p_size::DOUBLE AS a, p_retailprice AS b FROM part), s AS (SELECT quantile_cont(a, 0.5) AS ma, quantile_cont(a, 0.75) - quantile_cont(a, 0.25) AS ia, quantile_cont(b, 0.5) AS mb, quantile_cont(b, 0.75) - quantile_cont(b, 0.25) AS ib FROM f),
z AS (SELECT p_partkey, greatest(-10, least(10, (a - ma) / greatest(ia, 1e-6))) AS za, greatest(-10, least(10, (b - mb) / greatest(ib, 1e-6))) AS zb FROM f, s)
SELECT p_partkey, round((abs(za) + abs(zb)) / 2, 6) AS ood, (CASE WHEN abs(za) > 1 THEN 1 ELSE 0 END + CASE WHEN abs(zb) > 1 THEN 1 ELSE 0 END) AS extreme FROM z
""")
def robust_z(t):
    f = t("part").select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    q = lambda c, p: F.percentile(c, p)
    s = f.agg(q("a", 0.5).alias("ma"), (q("a", 0.75) - q("a", 0.25)).alias("ia"), q("b", 0.5).alias("mb"), (q("b", 0.75) - q("b", 0.25)).alias("ib"))
    z = lambda c: F.greatest(F.lit(-10.0), F.least(F.lit(10.0), (F.col(c) - F.col(f"m{c}")) / F.greatest(F.col(f"i{c}"), F.lit(1e-6))))
    rows = f.crossJoin(F.broadcast(s)).select("p_partkey", z("a").alias("za"), z("b").alias("zb"))  # one row
    return rows.select("p_partkey", r6((F.abs("za") + F.abs("zb")) / 2).alias("ood"), (F.when(F.abs("za") > 1, 1).otherwise(0) + F.when(F.abs("zb") > 1, 1).otherwise(0)).alias("extreme"))


@query("SELECT CASE WHEN n_regionkey IS NULL THEN 'unknown_region' WHEN n_nationkey % 7 = 0 THEN 'flagged' END AS reason, count(*) AS n FROM nation GROUP BY 1 HAVING reason IS NOT NULL")
def violations_report(t):
    rules = F.array_compact(F.array(F.when(F.col("n_regionkey").isNull(), F.lit("unknown_region")), F.when(F.col("n_nationkey") % 7 == 0, F.lit("flagged"))))
    return t("nation").select(F.explode(rules).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_events(t):
    return stream.tumbling(t("events"), "ts", "event_type", "value").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k
""")
def user_sessions(t):
    return stream.sessions(t("events"), "ts", "user_id").select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", "n")


@query(f"""
WITH d AS (SELECT doc_id, {SEQ_SQL} AS s FROM documents),
m AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id) AS nth, length(s) BETWEEN {LOW} AND {HIGH} AS ok, s IN (SELECT {SEQ_SQL} FROM benchmark) AS known FROM d),
a AS (SELECT doc_id, s, length(s)::INT AS n FROM m WHERE ok AND nth = 1 AND NOT known),
g AS (SELECT doc_id, n, c, count(*) AS k FROM (SELECT doc_id, n, unnest(string_split(s, '')) AS c FROM a) GROUP BY ALL),
f AS (SELECT doc_id, any_value(n) AS n, round(-sum(k / n::DOUBLE * log2(k / n::DOUBLE)), 9) AS entropy, round(max(k) / any_value(n)::DOUBLE, 9) AS share FROM g GROUP BY doc_id),
p AS (SELECT *, ({AVG_RANK.format(v='entropy')} - 1) / nullif(count(*) OVER () - 1, 0) AS a, 1 - ({AVG_RANK.format(v='share')} - 1) / nullif(count(*) OVER () - 1, 0) AS b FROM f),
q AS (SELECT doc_id, n, round((a + b) / 2, 9) AS score FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, doc_id) AS k FROM q)
SELECT doc_id, n, score FROM r WHERE k <= 5
""")
def select_library_top(t):
    """Flagship: mark rejections, features of what is accepted, percentile scores, quota by length."""
    docs = t("documents").select("doc_id", seq_col().alias("s"))
    marked = select.mark_all_seen(docs, t("benchmark").select(seq_col().alias("s")), "s", "doc_id", seq.alphabet_ok(F.col("s"), LOW, HIGH, LOWER))
    s = F.col("s")
    rows = graph.cut(marked.where("reason IS NULL").select("doc_id", F.length(s).alias("n"), seq.composition(s, LOWER).alias("c")))  # texts are read once
    rows = rows.select("doc_id", "n", F.round(seq.shares_entropy(F.col("c")), 9).alias("entropy"), F.round(F.array_max("c"), 9).alias("share"))
    rows = rank.percentile_scores(rows, {"a": ("entropy", False), "b": ("share", True)})
    rows = rows.select("doc_id", "n", F.round((F.col("a") + F.col("b")) / 2, 9).alias("score"))
    return select.top_per_group(rows, "n", [F.col("score").desc(), F.col("doc_id")], 5)


@query("""
SELECT l_partkey, round(avg(CASE WHEN l_quantity <= 16 THEN 1.0 ELSE 0.0 END), 6) AS success, round(quantile_cont(log2(l_quantity), 0.5), 6) AS q50, round(quantile_cont(log2(l_quantity), 0.9), 6) AS q90,
round(avg(CASE WHEN l_quantity <= 8 THEN 1.0 ELSE 0.0 END), 6) AS conservative FROM lineitem GROUP BY l_partkey
""")
def ground_truth(t):
    g = aggregate.ground_truth(t("lineitem"), "l_partkey", "l_quantity", 16.0)
    return g.select("l_partkey", *[r6(c).alias(c) for c in g.columns[1:]])


@query("SELECT p_partkey, round(1.0 / (count(*) OVER (PARTITION BY p_brand) * (SELECT count(DISTINCT p_brand) FROM part)), 9) AS weight FROM part")
def inverse_size_weights(t):
    return aggregate.inverse_size_weights(t("part").select("p_partkey", "p_brand"), "p_brand").select("p_partkey", F.round("weight", 9).alias("weight"))


@query("""
WITH r AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS d FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1)
SELECT l_orderkey, l_linenumber, ((l_quantity < a OR l_quantity > b)::INT + (l_extendedprice < c OR l_extendedprice > d)::INT) / 2.0 AS exceeds FROM lineitem, r
""")
def range_exceedance(t):
    l = t("lineitem")
    return aggregate.exceedance(l.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), l.where("l_returnflag = 'R' AND l_linenumber = 1"), ["l_quantity", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "exceeds")


@query("""
SELECT 'l_returnflag' AS slice, l_returnflag AS value, count(*) AS n, round(avg(abs(l_discount - l_tax)), 6) AS mae FROM lineitem GROUP BY l_returnflag
UNION ALL SELECT 'l_linestatus', l_linestatus, count(*), round(avg(abs(l_discount - l_tax)), 6) FROM lineitem GROUP BY l_linestatus
""")
def error_slices(t):
    l = t("lineitem").withColumn("e", F.col("l_discount") - F.col("l_tax"))
    return aggregate.error_slices(l, ["l_returnflag", "l_linestatus"], "e").select("slice", "value", "n", r6("mae").alias("mae"))


@query("""
WITH f AS (SELECT p_size > 40 AS big, p_retailprice > 1000 AS dear, p_size % 2 = 0 AS pos FROM part)
SELECT 'big' AS removed, sum((NOT dear)::INT)::BIGINT AS kept, sum((NOT dear AND pos)::INT)::BIGINT AS positives_kept FROM f
UNION ALL SELECT 'dear', sum((NOT big)::INT)::BIGINT, sum((NOT big AND pos)::INT)::BIGINT FROM f
""")
def rule_ablation(t):
    reasons = F.array_compact(F.array(F.when(F.col("p_size") > 40, "big"), F.when(F.col("p_retailprice") > 1000, "dear")))
    p = t("part").select(reasons.alias("reasons"), (F.col("p_size") % 2 == 0).alias("pos"))
    return aggregate.rule_ablation(p, "reasons", ["big", "dear"], "pos")


@query("WITH o AS (SELECT l_partkey, min(l_tax) AS a, max(l_tax) AS b FROM lineitem GROUP BY 1) SELECT round(sum(a), 6) AS total, sum((a <> b)::INT)::BIGINT AS conflicts FROM o")
def deduplicated_total(t):
    return aggregate.deduplicated_total(t("lineitem"), "l_partkey", "l_tax").select(r6("total").alias("total"), "conflicts")


@query("SELECT p_partkey, CASE WHEN p_size >= 5 AND p_brand <> 'Brand#11' THEN round(p_retailprice - 0.15 * (p_size % 3), 6) END AS score FROM part")
def masked_scores(t):
    s = select.masked_score(F.col("p_retailprice"), [F.col("p_size") >= 5, F.col("p_brand") != "Brand#11"], [((F.col("p_size") % 3).cast("double"), 0.15)])
    return t("part").select("p_partkey", r6(s).alias("score"))


@query("""
SELECT p_partkey, round(greatest(0, least(100, 100 * (50 - p_size) / 40.0)), 6) AS falling, round(greatest(0, 100 * (1 - greatest(20 - p_size, p_size - 30, 0) / 15.0)), 6) AS in_range,
round((p_size - 25) / 10.0 * 0.5 + (p_retailprice - 1000) / 200.0 * -0.25 + 0.1, 6) AS head FROM part
""")
def piecewise_scores_and_head(t):
    size = F.col("p_size").cast("double")
    head = seq.linear_head(F.array(size, F.col("p_retailprice")), [25, 1000], [10, 200], [0.5, -0.25], 0.1)
    return t("part").select("p_partkey", r6(seq.clamp_score(size, 10.0, 50.0, falling=True)).alias("falling"), r6(seq.range_score(size, 20.0, 30.0, 15.0)).alias("in_range"), r6(head).alias("head"))


@query("""
WITH r AS (SELECT l_orderkey, l_quantity AS a, l_extendedprice AS b, row_number() OVER () AS i FROM lineitem)
SELECT x.l_orderkey, round(avg(sign(x.a - y.a) * sign(x.b - y.b)), 6) AS tau FROM r x JOIN r y ON x.l_orderkey = y.l_orderkey AND x.i < y.i GROUP BY x.l_orderkey
""")
def kendall_within_orders(t):
    return metrics.kendall(t("lineitem"), "l_orderkey", "l_quantity", "l_extendedprice").select("l_orderkey", r6("tau").alias("tau"))
