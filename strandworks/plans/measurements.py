"""Queries of measurement tables: joins with evidence, normalisers, labels, contracts, exports."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import censor, text
from ..operators import aggregate, contracts, joins, measure, vectors
from ..sources import documents, tables
from .catalog import query, r6


@query("""
WITH c AS (SELECT l_partkey, l_linenumber, median(log2(l_quantity)) AS med, avg((l_quantity <= 16)::INT) AS share FROM lineitem GROUP BY ALL), d AS (SELECT l.l_partkey, l.l_linenumber, median(abs(log2(l_quantity) - med)) AS mad FROM lineitem l JOIN c USING (l_partkey, l_linenumber) GROUP BY ALL)
SELECT p_partkey, 1 AS l_linenumber, round(med, 6) AS median, round(mad, 6) AS mad, round(share, 6) AS share FROM part LEFT JOIN c ON c.l_partkey = p_partkey AND c.l_linenumber = 1 LEFT JOIN d ON d.l_partkey = p_partkey AND d.l_linenumber = 1
""")
def tensor_cells(t):
    m = t("part").select(F.col("p_partkey").alias("l_partkey"), F.lit(1).alias("l_linenumber"))
    c = joins.tensor_cells(m, t("lineitem").select("l_partkey", "l_linenumber", "l_quantity"), ["l_partkey", "l_linenumber"], "l_quantity")
    return c.select(F.col("l_partkey").alias("p_partkey"), "l_linenumber", *[r6(n).alias(n) for n in ("median", "mad", "share")])


@query("SELECT o_orderkey, o_custkey, round(c_acctbal, 2) AS c_acctbal FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def aligned_scores(t):
    c = t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    return joins.scores_for(t("orders").select("o_orderkey", "o_custkey"), c, "o_custkey", "c_acctbal", F.col("o_custkey") >= 0).select("o_orderkey", "o_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))


@query("""
WITH w AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem), k AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_returnflag = 'R') SELECT a AS id_a, b AS id_b FROM w EXCEPT SELECT a, b FROM k
""")
def missing_pairs(t):
    p = t("lineitem").select(F.col("l_suppkey").alias("id_a"), F.col("l_partkey").alias("id_b"), "l_returnflag")
    return joins.missing_pairs(p, p.where("l_returnflag = 'R'"))


@query("""
WITH a AS (SELECT l_partkey AS k, min(l_quantity) AS al, max(l_quantity) AS au FROM lineitem GROUP BY 1), b AS (SELECT p_partkey AS k, p_retailprice / 100 AS bl, CASE WHEN p_size > 10 THEN p_retailprice / 50 END AS bu FROM part)
SELECT k, r AS ratio, coalesce(bl >= r * au, false)::INT AS certain, (bu IS NULL OR bu >= r * al)::INT AS possible FROM a JOIN b USING (k), (SELECT unnest([0.25::DOUBLE, 1.0, 4.0]) AS r)
""")
def ratio_bounds_by_key(t):
    a = t("lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.min("l_quantity").alias("lower"), F.max("l_quantity").alias("upper"))
    b = t("part").select(F.col("p_partkey").alias("k"), (F.col("p_retailprice") / 100).alias("lower"), F.when(F.col("p_size") > 10, F.col("p_retailprice") / 50).alias("upper"))
    return joins.ratio_bounds_by_key(a, b, "k", [0.25, 1.0, 4.0])


@query("""
WITH r AS (SELECT l_partkey AS pk, l_suppkey AS sk, CASE WHEN l_linenumber > 2 THEN l_linenumber END AS ln, count(*) AS matches, min(l_orderkey) AS id FROM lineitem GROUP BY ALL), l AS (SELECT event_id, event_id % 200 + 1 AS pk, event_id % 10 + 1 AS sk, CASE WHEN event_id % 3 = 0 THEN 3 END AS ln FROM events)
SELECT event_id, coalesce(matches, 0) AS matches, CASE WHEN matches = 1 THEN id END AS match FROM l LEFT JOIN r ON l.pk IS NOT DISTINCT FROM r.pk AND l.sk IS NOT DISTINCT FROM r.sk AND l.ln IS NOT DISTINCT FROM r.ln
""")
def unique_match(t):
    right = t("lineitem").select(F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"), F.when(F.col("l_linenumber") > 2, F.col("l_linenumber")).cast("int").alias("ln"), "l_orderkey")
    left = t("events").select("event_id", (F.col("event_id") % 200 + 1).alias("pk"), (F.col("event_id") % 10 + 1).alias("sk"), F.when(F.col("event_id") % 3 == 0, 3).alias("ln"))
    return joins.unique_match(left, right, ["pk", "sk", "ln"], "l_orderkey").select("event_id", "matches", "match")


@query("""
SELECT a.o_orderkey AS id_a, b.o_orderkey AS id_b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey WHERE a.o_orderkey <> b.o_orderkey AND (abs(a.o_totalprice - b.o_totalprice) <= 0.005 OR abs(a.o_totalprice - b.o_totalprice) <= 0.01 * greatest(abs(a.o_totalprice), abs(b.o_totalprice)))
""")
def near_values(t):
    o = t("orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_totalprice")
    return joins.near_values(o, o, ["o_custkey"], "o_totalprice").where("id_a <> id_b")


@query("SELECT l.s_suppkey AS id_a, r.s_suppkey AS id_b, l.s_name AS left_name, r.s_name AS right_name FROM supplier l JOIN supplier r ON r.s_suppkey = l.s_suppkey + 1")
def pairs_of_ids(t):
    s = t("supplier")
    ids = s.select(F.col("s_suppkey").alias("id_a"), (F.col("s_suppkey") + 1).alias("id_b")).join(s.select(F.col("s_suppkey").alias("id_b")), "id_b", "left_semi")
    return joins.pairs_of_ids(ids.select("id_a", "id_b"), s.select("s_suppkey", "s_name"), "s_suppkey").select("id_a", "id_b", F.col("left.s_name").alias("left_name"), F.col("right.s_name").alias("right_name"))


@query("SELECT 'p_brand' AS key, (SELECT count(*) FROM (SELECT p_brand FROM part WHERE p_size < 20 INTERSECT SELECT p_brand FROM part WHERE p_size >= 20)) AS n UNION ALL SELECT 'p_partkey', (SELECT count(*) FROM (SELECT p_partkey FROM part WHERE p_size < 20 INTERSECT SELECT p_partkey FROM part WHERE p_size >= 20))")
def disjoint_parts(t):
    return joins.overlaps(t("part").where("p_size < 20"), t("part").where("p_size >= 20"), ["p_brand", "p_partkey"])


@query("""
WITH a AS (SELECT l_partkey AS x, l_suppkey AS y, avg(l_discount) * 10 AS r FROM lineitem WHERE l_linenumber < 4 GROUP BY ALL), b AS (SELECT l_partkey AS x, l_suppkey AS y, avg(l_discount) * 10 AS r FROM lineitem WHERE l_linenumber >= 3 GROUP BY ALL)
SELECT coalesce(a.x, b.x) AS id_a, coalesce(a.y, b.y) AS id_b, round(a.r, 6) AS ratio_a, round(b.r, 6) AS ratio_b FROM a FULL JOIN b ON a.x = b.x AND a.y = b.y WHERE coalesce(a.r >= 0.55, false) <> coalesce(b.r >= 0.55, false)
""")
def changed_edges(t):
    p = lambda w: t("lineitem").where(w).groupBy(F.col("l_partkey").alias("id_a"), F.col("l_suppkey").alias("id_b")).agg((F.avg("l_discount") * 10).alias("ratio"))
    return joins.changed_edges(p("l_linenumber < 4"), p("l_linenumber >= 3"), 0.55).select("id_a", "id_b", r6("ratio_a").alias("ratio_a"), r6("ratio_b").alias("ratio_b"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'modified' ELSE 'reported_linear_free' END AS form, p_size % 4 > 1 AND p_size > 10 AS usable FROM part")
def chemistry_gates(t):
    n = F.col("p_size") % 4
    form = measure.chemistry(F.when(n == 1, "ACT").otherwise("none"), F.lit(" N/A "), F.lit("[]"), n != 0)
    p = t("part").withColumn("form", form)
    return p.select("p_partkey", "form", measure.usable(F.lit(True), F.col("form"), F.when(F.col("p_size") > 10, 1.0), F.lit(None).cast("double")).alias("usable"))


@query("""
SELECT event_id, value > 20 AS exact, event_id % 4 <> 3 AS classification, value > 20 OR event_id % 3 = 0 AS "interval", value > 20 AND event_id % 2 = 0 AS exact_strict, event_id % 4 <> 3 AND event_id % 2 = 0 AS classification_strict, (value > 20 OR event_id % 3 = 0) AND event_id % 2 = 0 AS interval_strict, value > 20 AND event_id % 5 = 0 AS strain_exact FROM events
""")
def training_masks(t):
    i = F.col("event_id")
    m = measure.training_masks(F.col("value") > 20, F.when(i % 4 != 3, 1), F.when((F.col("value") > 20) | (i % 3 == 0), 1.0), F.lit(None), F.when(i % 2 == 0, "reported_linear_free").otherwise("modified"), F.when(i % 5 == 0, "strain").otherwise("species"))
    return t("events").select("event_id", *[c.alias(n) for n, c in m.items()])


@query("""
WITH r AS (SELECT c_custkey AS id, c_custkey % 5 AS pf, c_nationkey % 4 - 1 AS gf, c_custkey % 7 <> 0 AS prim, c_custkey % 3 <> 0 AS exact FROM customer)
SELECT id, pf <> 1 AND exact AND gf >= 0 AND gf <> 2 AS training, prim AND pf = 1 AND exact AND gf >= 0 AND gf = 2 AS validation FROM r
""")
def regime_masks(t):
    k = F.col("c_custkey")
    c = t("customer").select(k.alias("id"), (k % 5).alias("peptide_fold"), (F.col("c_nationkey") % 4 - 1).alias("genome_fold"), (k % 7 != 0).alias("primary"), F.when(k % 3 != 0, "exact_label").otherwise("unknown").alias("genome_status"))
    return measure.regime_masks(c, "both", 1, 2).select("id", "training", "validation")


@query("SELECT n_nationkey, r_name AS region, CASE WHEN n_nationkey % 2 = 0 THEN r_name END AS covered FROM nation JOIN region ON n_regionkey = r_regionkey")
def canonical_names(t):
    names = t("region").select(F.col("r_regionkey").cast("string").alias("alias"), F.col("r_name").alias("canonical"))
    n = measure.canonical_names(t("nation").withColumn("k", F.col("n_regionkey").cast("string")), "k", names, "region")
    return n.select("n_nationkey", "region", measure.if_covered(F.col("region"), F.when(F.col("n_nationkey") % 2 == 0, 100.0).otherwise(90.0)).alias("covered"))


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: x::DOUBLE) AS e FROM embeddings)
SELECT 'consensus:' || vec_id || ':' || k AS observation_id, k AS target, round(CASE WHEN (CASE k WHEN 'a' THEN e[3] ELSE e[4] END) > 0 THEN (CASE k WHEN 'a' THEN e[3] ELSE e[4] END) END, 6) AS consensus_um FROM v, (SELECT unnest(['a', 'b']) AS k)
""")
def consensus_observations(t):
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    rows = t("embeddings").select(F.col("vec_id").alias("id"), F.lit("AC").alias("sequence"), F.create_map(F.lit("a"), F.array(at(0), at(1), at(2)), F.lit("b"), F.array(at(0), at(1), at(3))).alias("targets"))
    return measure.from_consensus(rows).select("observation_id", "target", r6("consensus_um").alias("consensus_um"))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, CASE l_linenumber % 4 WHEN 0 THEN '~' WHEN 1 THEN '' WHEN 2 THEN '>' ELSE '≤' END AS sign, CASE l_linenumber % 3 WHEN 0 THEN 'µg/mL' WHEN 1 THEN 'µM' ELSE 'IU' END AS u, l_returnflag = 'R' AS free, l_shipmode_known AS known FROM (SELECT *, l_linestatus = 'O' AS l_shipmode_known FROM lineitem)),
v AS (SELECT *, CASE WHEN sign = '~' THEN NULL WHEN u = 'µM' THEN q WHEN u = 'µg/mL' AND free THEN q * 1000 / 2000.0 END AS um FROM r)
SELECT l_orderkey, l_linenumber, round(um, 6) AS value_um, CASE sign WHEN '~' THEN NULL WHEN '' THEN '=' WHEN '≤' THEN '<=' ELSE sign END AS relation,
(sign = '~')::INT + (sign <> '~' AND u = 'µg/mL' AND NOT free)::INT + (sign <> '~' AND u = 'IU')::INT + (NOT free)::INT + (NOT known)::INT AS n_reasons,
CASE WHEN um IS NULL OR sign = '~' THEN NULL WHEN sign IN ('', '≤') AND um <= 16 THEN 1 WHEN (sign = '' AND um > 16) OR (sign = '>' AND um >= 16) THEN 0 END AS active FROM v
""")
def measured_observations(t):
    n = F.col("l_linenumber")
    pick = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (n % k + 1).cast("int"))
    rows = t("lineitem").select("l_orderkey", "l_linenumber", F.lit("ACDEFGHIK").alias("sequence"), F.when(F.col("l_linestatus") == "O", "E.  coli K12").otherwise("other").alias("target"), F.concat(pick(("~", "", ">", "≤"), 4), F.lit(" "), F.col("l_quantity").cast("decimal(9,2)").cast("string")).alias("concentration"), pick(("µg/mL", "µM", "IU"), 3).alias("unit"), F.when(F.col("l_returnflag") == "R", "reported_linear_free").otherwise("modified").alias("form"), F.lit(False).alias("form_conflict"))
    aliases = t("region").sparkSession.createDataFrame([("E. coli K12", "EC")], "alias string, canonical string")
    return measure.from_measured(rows, F.lit(2000.0), aliases).select("l_orderkey", "l_linenumber", r6("value_um").alias("value_um"), "relation", F.size("exclusion_reasons").alias("n_reasons"), "active")


@query("""
SELECT event_id, round(CASE WHEN r IN ('=', '>') THEN log2(v) END, 6) AS lower_log2, round(CASE WHEN r IN ('=', '<') THEN log2(v) END, 6) AS upper_log2 FROM (SELECT event_id, value + 1 AS v, CASE event_id % 3 WHEN 0 THEN '=' WHEN 1 THEN '<' ELSE '>' END AS r FROM events)
""")
def log_bounds(t):
    e = t("events").select("event_id", (F.col("value") + 1).alias("v"), F.element_at(F.array(*map(F.lit, ("=", "<", ">"))), (F.col("event_id") % 3 + 1).cast("int")).alias("r"))
    return measure.to_bounds(e, "v", "r").select("event_id", r6("lower_log2").alias("lower_log2"), r6("upper_log2").alias("upper_log2"))


@query("""
SELECT event_id, CASE WHEN p IS NULL THEN 'no_percentage' WHEN p > 100 THEN 'percentage_out_of_range' END AS reject, CASE WHEN p = 50 THEN 'measured_half' WHEN p <= 100 THEN 'percentage' END AS endpoint FROM (SELECT event_id, CASE WHEN event_id % 6 < 5 THEN (event_id % 6) * 50 END AS p FROM events)
""")
def percent_endpoints(t):
    e = t("events").select("event_id", F.lit(1.0).alias("value"), F.lit("=").alias("relation"), F.when(F.col("event_id") % 6 < 5, (F.col("event_id") % 6) * 50).alias("percent"), F.lit("human").alias("species"))
    return measure.percent_endpoint(e).select("event_id", "reject", "endpoint")


@query("""
WITH r AS (SELECT l_partkey AS m, l_returnflag AS species, l_linestatus AS target, l_quantity AS v, CASE l_linenumber % 3 WHEN 0 THEN '=' WHEN 1 THEN '<' ELSE '>' END AS rel FROM lineitem), a AS (SELECT DISTINCT m, species, target, v, rel FROM r),
b AS (SELECT *, (rel IN ('=', '<') AND v <= 16)::INT AS lo, (rel = '<' OR v < 16 OR (v = 16 AND rel = '='))::INT AS hi FROM a), c AS (SELECT m, species, min(lo) AS hit_lower, max(hi) AS hit_upper, count(*) AS assays, list_sort(list_distinct(list(target))) AS t FROM b GROUP BY m, species)
SELECT hit_lower, hit_upper, assays, '["' || array_to_string(t, '","') || '"]' AS targets, count(*) AS n FROM c GROUP BY ALL
""")
def molecule_labels(t):
    rel = F.element_at(F.array(*map(F.lit, ("=", "<", ">"))), (F.col("l_linenumber") % 3 + 1).cast("int"))
    rows = t("lineitem").select(F.col("l_partkey").alias("m"), F.col("l_returnflag").alias("species"), F.col("l_linestatus").alias("target"), F.col("l_quantity").alias("v"), rel.alias("rel"))
    return measure.molecule_labels(rows, ["m"], "species", "v", "rel", ["m", "target"]).groupBy("hit_lower", "hit_upper", "assays", "targets").agg(F.count("*").alias("n"))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity AS v, l_extendedprice / 100 AS h, CASE l_linenumber % 3 WHEN 0 THEN '=' WHEN 1 THEN '<=' ELSE '>' END AS a, CASE l_linenumber % 2 WHEN 0 THEN '=' ELSE '>' END AS b FROM lineitem),
x AS (SELECT *, CASE WHEN a = '<=' THEN 0 ELSE v END AS ml, CASE WHEN a = '>' THEN NULL ELSE v END AS mu, a = '=' AS shut, CASE WHEN b = '=' THEN h END AS hu FROM r)
SELECT l_orderkey, l_linenumber, coalesce(mu <= 16 AND h >= 8 * mu, false)::INT AS certain, ((ml < 16 OR (ml = 16 AND shut)) AND (hu IS NULL OR hu > 8 * ml OR (hu = 8 * ml AND shut)))::INT AS possible FROM x
""")
def joint_hits(t):
    n = F.col("l_linenumber")
    mic = censor.bounds(F.element_at(F.array(*map(F.lit, ("=", "<=", ">"))), (n % 3 + 1).cast("int")), F.col("l_quantity"))
    hc = censor.bounds(F.when(n % 2 == 0, "=").otherwise(">"), F.col("l_extendedprice") / 100)
    j = t("lineitem").select("l_orderkey", "l_linenumber", measure.joint_bounds(mic, hc).alias("j"))
    return j.select("l_orderkey", "l_linenumber", "j.certain", "j.possible")


@query("SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') THEN 'used' WHEN c_acctbal > 0 THEN 'certified_unused' ELSE 'unknown' END AS exposure FROM customer")
def exposure_inventory(t):
    c = t("customer")
    return measure.exposure_of(c, "c_custkey", t("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), c.where("c_acctbal > 0")).select("c_custkey", "exposure")


@query("""
WITH p AS (SELECT 'training' AS part, doc_id, text, lang, source FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT 'inference', doc_id, text, NULL, NULL FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'scoring', doc_id, NULL, lang, source FROM documents WHERE doc_id % 3 = 0)
SELECT part, CASE part WHEN 'training' THEN 'doc_id,text,lang,source' WHEN 'inference' THEN 'doc_id,text' ELSE 'doc_id,lang,source' END AS columns, count(*) AS n, sum(doc_id)::BIGINT AS ids, sum(length(text))::BIGINT AS chars, count(DISTINCT (lang, source)) FILTER (lang IS NOT NULL OR source IS NOT NULL) AS labels FROM p GROUP BY part
""")
def isolated_exports(t):
    """What each export holds: held-out inputs have no label, held-out labels no input, and the parts share no row."""
    d = t("documents").withColumn("part", F.when(F.col("doc_id") % 3 == 0, "holdout").otherwise("train"))
    out = None
    for name, df in measure.isolated_exports(d, "part", "doc_id", ["text"], ["lang", "source"]).items():
        chars = F.sum(F.length("text")) if "text" in df.columns else F.lit(None).cast("long")
        kinds = F.count_distinct(F.when(F.col("lang").isNotNull() | F.col("source").isNotNull(), F.struct("lang", "source"))) if "lang" in df.columns else F.lit(0).cast("long")
        row = df.agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"), chars.alias("chars"), kinds.alias("labels")).select(F.lit(name).alias("part"), F.lit(",".join(df.columns)).alias("columns"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'new' ELSE p_brand END AS p_brand, p_size % 2 = 0 AS applied FROM part")
def applied_evidence(t):
    p = t("part").select("p_partkey", "p_brand", F.sha2("p_name", 256).alias("h"), "p_size")
    e = p.select("p_partkey", F.lit("new").alias("p_brand"), F.when(F.col("p_size") % 2 == 0, F.col("h")).otherwise("stale").alias("h"))
    return measure.apply_evidence(p, e, "p_partkey", "h", ["p_brand"]).select("p_partkey", "p_brand", "applied")


@query("""
WITH r AS (SELECT event_id, value AS v, event_id % 4 AS k FROM events) SELECT reason, count(*) AS n FROM (
SELECT 'unknown_relation' AS reason FROM r WHERE k = 1 UNION ALL SELECT 'value_without_relation' FROM r WHERE k = 2 AND v IS NOT NULL UNION ALL SELECT 'value_not_positive' FROM r WHERE v <= 0 UNION ALL SELECT 'relation_without_value' FROM r WHERE k <> 2 AND v IS NULL UNION ALL SELECT 'inverted_bounds' FROM r WHERE k = 3 UNION ALL SELECT 'exact_with_open_bounds' FROM r WHERE event_id % 8 = 0 UNION ALL SELECT 'percent_out_of_range' FROM r WHERE event_id % 130 > 100) GROUP BY reason
""")
def observation_issues(t):
    k = F.col("event_id") % 4
    o = t("events").select(F.col("event_id").alias("observation_id"), F.when(k == 1, "~").when(k != 2, F.when(k == 0, "=").otherwise("<")).alias("relation"), F.col("value").alias("value_um"), F.when(k == 3, 2.0).otherwise(1.0).alias("lower"), F.when(F.col("event_id") % 8 == 0, 3.0).otherwise(1.0).alias("upper"), F.lit(None).cast("int").alias("active"), (F.col("event_id") % 130).cast("double").alias("percent"))
    return measure.observation_issues(o).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT replay, count(*) AS n FROM (SELECT CASE p_size % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'changed_text' WHEN 2 THEN 'changed_value' ELSE 'ok' END AS replay FROM part) GROUP BY replay")
def cell_replay(t):
    k = F.col("p_size") % 4
    base = t("part").select(F.lit("f").alias("file"), F.lit("t").alias("tbl"), F.col("p_partkey").alias("row"), F.lit(1).alias("col"), "p_size")
    grid = base.where(k != 0).select("file", "tbl", "row", "col", F.when(k == 1, "> 99").otherwise(" >  8 ").alias("text"))
    cells = base.select("file", "tbl", "row", "col", F.lit("> 8").alias("cell_text"), F.when(k == 2, 9.0).otherwise(8.0).alias("value"))
    return measure.grid_values(grid, cells).groupBy("replay").agg(F.count("*").alias("n"))


@query("""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part), c AS (
  SELECT p_brand AS tbl, 2 * (i - 1) AS row, 0 AS col, p_partkey::VARCHAR AS text FROM p UNION ALL SELECT p_brand, 2 * (i - 1) + 1, 0, p_partkey::VARCHAR FROM p
  UNION ALL SELECT p_brand, 2 * (i - 1), unnest([1, 2]), p_name FROM p UNION ALL SELECT p_brand, 2 * (i - 1) + 1, 1, p_size::VARCHAR FROM p UNION ALL SELECT p_brand, 2 * (i - 1) + 1, 2, CASE WHEN p_size % 3 = 0 THEN '> 8' ELSE p_type END FROM p)
SELECT tbl, "row"::INT AS "row", col, text FROM c
""")
def document_cells(t):
    """An XML article for each brand, made from its parts with cells over rows and columns, read back cell by cell."""
    return documents.grids(_articles(t), "file").select("tbl", "row", "col", "text")


def _articles(t):
    """(file, content): a part is two table rows, its key over both, its name over two columns."""
    limit = F.when(F.col("p_size") % 3 == 0, "> 8").otherwise(F.col("p_type"))
    cell = lambda c, more="": F.concat(F.lit(f"<td{more}>"), F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit(">"), F.lit("&gt;")), F.lit("</td>"))
    rows = F.concat(F.lit("<tr>"), cell(F.col("p_partkey").cast("string"), ' rowspan="2"'), cell(F.col("p_name"), ' colspan="2"'), F.lit("</tr><tr>"), cell(F.col("p_size").cast("string")), cell(limit), F.lit("</tr>"))
    body = t("part").groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", rows.alias("r")))), lambda x: x["r"]), "").alias("rows"))
    xml = F.concat(F.lit('<article><table-wrap id="'), "p_brand", F.lit('"><table>'), "rows", F.lit("</table></table-wrap></article>"))
    return body.select(F.concat("p_brand", F.lit(".xml")).alias("file"), xml.cast("binary").alias("content"))


@query("""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part)
SELECT p_brand AS tbl, (2 * i - 1)::INT AS "row", CASE WHEN p_size % 3 <> 0 THEN 'changed_text' WHEN p_size % 2 = 0 THEN 'ok' ELSE 'changed_value' END AS replay FROM p
""")
def replayed_documents(t):
    """Registered values checked against the cells of the documents that they were taken from."""
    grid = documents.grids(_articles(t), "file")
    place = W.partitionBy("p_brand").orderBy("p_partkey")
    told = t("part").select(F.concat("p_brand", F.lit(".xml")).alias("file"), F.col("p_brand").alias("tbl"), (2 * F.row_number().over(place) - 1).alias("row"), F.lit(2).alias("col"), F.lit("> 8").alias("cell_text"), F.when(F.col("p_size") % 2 == 0, 8.0).otherwise(9.0).alias("value"))
    return measure.grid_values(grid, told).select("tbl", "row", "replay")


@query("""
SELECT p_partkey, x.target, x.prediction, x.supported, CASE WHEN x.supported THEN '' ELSE 'no_supported_head' END AS fallback_reason FROM part, LATERAL (SELECT unnest([{target: 'a', prediction: CASE WHEN p_size > 20 THEN p_size::DOUBLE ELSE p_retailprice END, supported: p_size > 20}, {target: 'b', prediction: p_retailprice, supported: true}]) AS x)
""")
def prediction_rows(t):
    p = t("part").select("p_partkey", F.when(F.col("p_size") > 20, F.col("p_size").cast("double")).alias("a"), F.col("p_retailprice").alias("b"), F.col("p_retailprice").alias("a_base"), F.col("p_retailprice").alias("b_base"))
    return measure.prediction_rows(p, "p_partkey", ["a", "b"], "base")


@query("SELECT p_partkey, 'a' AS target, round(0.25 * p_retailprice + 0.75 * p_size, 6) AS prediction FROM part")
def blended_targets(t):
    one = lambda c: t("part").select("p_partkey", F.lit("a").alias("target"), F.col(c).cast("double").alias("prediction"))
    return measure.blend_targets(one("p_size"), one("p_retailprice"), "p_partkey", 0.25).withColumn("prediction", r6("prediction"))


@query("""
WITH m AS (SELECT p_partkey AS k, p_size AS v, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS nth, upper(regexp_replace(p_name, ' ', '', 'g')) AS s, p_name FROM part), r AS (SELECT DISTINCT p_name FROM part WHERE p_size = 7)
SELECT reason, count(*) AS n FROM (SELECT 'invalid_alphabet' AS reason FROM m WHERE NOT regexp_full_match(s, '[ACDEFGHIKLMNPQRSTVWY]*') UNION ALL SELECT 'length_out_of_range' FROM m WHERE length(s) NOT BETWEEN 8 AND 14 UNION ALL SELECT 'duplicate_sequence' FROM (SELECT row_number() OVER (PARTITION BY s ORDER BY k) AS n FROM m) WHERE n > 1
UNION ALL SELECT 'exact_reference_overlap' FROM m WHERE s IN (SELECT s FROM m WHERE v = 7)) GROUP BY reason
""")
def record_issues(t):
    p = t("part").select("p_partkey", "p_size", F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("s"))
    return contracts.record_issues(p, "p_partkey", "s", "p_partkey", p.where("p_size = 7"), low=8, high=14).groupBy("reason").agg(F.count("*").alias("n"))


@query("""
SELECT 'library_size' AS reason, abs(count(*) - 100)::BIGINT AS n FROM part UNION ALL SELECT 'library_repeats', count(*) - count(DISTINCT p_name) FROM part
UNION ALL SELECT 'top_order_differs', least(10, count(DISTINCT p_name)) FROM part
""")
def submission_issues(t):
    """All parts as a library of a hundred, ten of them as a top list whose ranking runs the other way."""
    p = t("part").select(F.col("p_name").alias("s"), "p_partkey")
    first = p.groupBy("s").agg(F.min("p_partkey").alias("k")).orderBy("k").limit(10)
    top = first.select("s", F.row_number().over(W.partitionBy().orderBy("k")).alias("place"))  # ten rows
    backwards = top.select("s", (11 - F.col("place")).alias("rank"), (F.col("place") / 10.0).alias("score"))
    return contracts.submission_issues(p.select("s"), top, backwards, "s", 100, 10)


@query("SELECT 'not_finite:value' AS \"check\", count(*) FILTER (value IS NULL) AS n FROM events UNION ALL SELECT 'missing_key', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT user_id FROM events) UNION ALL SELECT 'unexpected_key', count(*) FROM (SELECT user_id FROM events EXCEPT SELECT c_custkey FROM customer) UNION ALL SELECT 'quota_differs', count(*) FROM (SELECT event_type FROM events GROUP BY 1 HAVING count(*) <> 100)")
def quality_report(t):
    e = t("events").select(F.col("user_id").alias("k"), "value", "event_type")
    return contracts.quality_report(e, ["value"], "k", t("customer").select(F.col("c_custkey").alias("k")), e.select("event_type").distinct().withColumn("quota", F.lit(100)), "event_type")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey, l_returnflag, CASE WHEN l_tax > 0.04 THEN l_linestatus END ORDER BY l_orderkey, l_linenumber) > 1 AS repeated FROM lineitem")
def duplicate_flags(t):
    l = t("lineitem").withColumn("s", F.when(F.col("l_tax") > 0.04, F.col("l_linestatus")))
    return contracts.duplicate_flags(l, ["l_partkey", "l_returnflag", "s"], F.struct("l_orderkey", "l_linenumber")).select("l_orderkey", "l_linenumber", "repeated")


@query("SELECT row_number() OVER (ORDER BY p_partkey) AS rank, p_partkey, p_name, round(1 - (row_number() OVER (ORDER BY p_partkey) - 1) / count(*) OVER (), 9) AS final_score FROM part")
def ranking_rows(t):
    from ..operators import rank

    p = rank.ordinal(t("part"), "p_partkey", "i").withColumn("place", F.col("i") + 1)
    return tables.ranking(p, "p_partkey", "p_name", "place").withColumn("final_score", F.round("final_score", 9))


@query("SELECT source, count(*) AS n FROM (SELECT 'a' AS source FROM nation UNION ALL SELECT 'b' FROM region) GROUP BY source")
def registered_union(t):
    n, r = t("nation").select(F.col("n_name").alias("name")), t("region").select(F.col("r_name").alias("name"))
    return tables.union_of({"a": (n, 25), "b": (r, 5)}).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT vec_id, round(list_avg(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS mean FROM embeddings")
def pooled_vectors(t):
    tokens = F.transform("embedding", lambda x: F.array(x.cast("double")))
    padded = F.concat(F.array(F.array(F.lit(9.0))), tokens, F.array(F.array(F.lit(9.0))))
    return vectors.cached_vectors(t("embeddings").select("vec_id"), t("embeddings").select("vec_id", "embedding"), "vec_id", "embedding").select("vec_id", r6(F.get(vectors.mean_pool(padded), F.lit(0))).alias("mean"))


@query("SELECT l_partkey, round(avg(l_tax), 6) AS mean FROM lineitem WHERE l_linenumber IN (1, 2, 3) GROUP BY 1 HAVING count(DISTINCT l_linenumber) = 3")
def complete_panel_means(t):
    return aggregate.complete_means(t("lineitem"), "l_partkey", "l_linenumber", "l_tax", [1, 2, 3]).withColumn("mean", r6("mean"))


@query("SELECT l_partkey, '[' || array_to_string(list_sort(list_distinct(list('\"' || l_returnflag || '\"'))), ',') || ']' AS \"values\" FROM lineitem GROUP BY 1")
def sorted_lists(t):
    return aggregate.sorted_list(t("lineitem"), "l_partkey", "l_returnflag")


@query("SELECT sha256('1995:' || lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g')))) AS key, CASE WHEN lower(p_brand) = 'brand#11' THEN NULL ELSE p_brand END AS brand, p_partkey FROM part")
def publication_keys(t):
    b = F.when(F.lower("p_brand") == "brand#11", " N/A ").otherwise(F.concat(F.lit(" "), F.col("p_brand")))
    return t("part").select(censor.publication_key(F.col("p_name"), F.lit(1995)).alias("key"), censor.to_null(b).alias("brand"), "p_partkey")
