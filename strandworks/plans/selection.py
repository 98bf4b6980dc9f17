"""Queries of quotas, libraries, diverse heads, sets, similarity joins and graphs."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import align, kernels, text
from ..operators import aggregate, graph, greedy, joins, measure, prefix, quota, rank, select
from .catalog import AVG_RANK, query, r6

LCS = """list_reduce(list_prepend([0] || list_transform(range(1, length({b}) + 1), lambda i: 0), list_transform(range(1, length({a}) + 1), lambda i: [i])), lambda row, p:
  list_reduce(list_prepend([0], list_transform(range(1, length({b}) + 1), lambda j: [j])), lambda got, j: got || [CASE WHEN {a}[p[1]] = {b}[j[1]] THEN row[j[1]] + 1 ELSE greatest(row[j[1] + 1], got[j[1]]) END]))[-1]"""


@query("""
WITH w AS (SELECT k, pow(coalesce(n, 0) + 1.0, 0.75) AS w FROM (SELECT unnest(range(1, 61))::INT AS k) LEFT JOIN (SELECT p_size AS k, count(*) AS n FROM part GROUP BY 1) USING (k)),
e AS (SELECT k, 777 * w / sum(w) OVER () AS x FROM w), f AS (SELECT k, floor(x) AS fl, row_number() OVER (ORDER BY x - floor(x) DESC, k) AS i, 777 - sum(floor(x)) OVER () AS rest FROM e)
SELECT k AS p_size, (fl + (i <= rest)::INT)::BIGINT AS quota FROM f
""")
def tempered_quotas(t):
    return quota.length_quotas(t("part"), "p_size", 777, 1, 60)


@query("SELECT p_partkey FROM part WHERE p_size > 5 ORDER BY p_partkey LIMIT 100")
def library_first(t):
    return quota.library(t("part").where("p_size > 5"), "L0", 100, None, "p_size", "p_brand", [], "p_partkey").select("p_partkey")


@query(None)
def bounded_quotas_by_size(t):
    """Each size's total of parts over brands, weighted by price, no brand above its supply; tested against the rule by hand."""
    p = t("part").groupBy("p_size", "p_brand").agg(F.count("*").alias("cap"), F.sum("p_retailprice").alias("w")).join(t("part").groupBy("p_size").agg(F.floor(F.count("*") / 2).alias("total")), "p_size")
    return quota.bounded_quotas(p, "p_size", "p_brand", "w", "cap", "total")


@query(None)
def redistributed_quotas(t):
    """Quotas of eight a size, moved to where parts are; tested by hand."""
    have = t("part").groupBy("p_size").agg(F.least(F.count("*"), 3 * F.col("p_size")).alias("have"))
    spine = W.partitionBy()  # sizes, few
    mean = F.sum("have").over(spine) / F.count("*").over(spine)
    return quota.redistribute(have.withColumn("want", F.least(F.lit(8), mean).cast("long")), "p_size", "want", "have")[0]


@query(None)
def library_by_reference_mix(t):
    """Turn-by-turn library of parts with clusters' shares half blended with those of dear parts; tested by hand."""
    p = t("part")
    order = [F.col("p_retailprice"), F.col("p_partkey")]
    chosen = select.round_robin(p, "p_size", "p_brand", order, 5)
    return quota.reference_mix(p, chosen, p.where("p_retailprice > 1000"), "p_size", "p_brand", order, 0.5).select("p_partkey", "p_size", "p_brand")


@query(None)
def diverse_top(t):
    """Parts by price, diverse by local similarity, a ladder of limits; tested against a scan by hand."""
    steps = [greedy.Step(500, 2, 0.35), greedy.Step(1000, 2, 0.45), greedy.Step(1000, 4, 0.55), greedy.Step(1000, 4, 0.65)]
    return greedy.diverse_top(t("part"), "p_partkey", "p_name", "p_retailprice", "p_partkey", 20, steps, {"hard": F.col("p_size") < 3}, "p_size", short=True)


@query(None)
def portfolio(t):
    """Brands that raise the lowest tenth of line numbers' totals most; tested by hand."""
    hits = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "l_linenumber").agg(F.sum("l_quantity").alias("v"))
    whole = hits.select("p_brand").distinct().crossJoin(hits.select("l_linenumber").distinct()).join(hits, ["p_brand", "l_linenumber"], "left").fillna(0.0)  # brands by line numbers, few
    return greedy.portfolio(whole, "p_brand", "l_linenumber", "v", 5, tail=0.1)


@query("""
WITH r AS (SELECT p_partkey, p_size, p_retailprice, p_partkey % 97 AS c FROM part), a AS (SELECT *, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS i FROM r)
SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (PARTITION BY c ORDER BY p_size DESC, p_partkey DESC) AS n FROM a) WHERE n = 1
""")
def last_of_each(t):
    p = t("part").withColumn("c", F.col("p_partkey") % 97)
    return select.keep_last(p, ["c"], [F.col("p_size"), F.col("p_partkey")]).select("p_partkey")


@query("""
WITH r AS (SELECT *, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part)
SELECT count(*) FILTER (a <= 100 AND b <= 100) AS top_overlap, count(*) FILTER (a <= 100) AS top_before, round(corr(a, b), 6) AS rank_correlation, max(abs(p_size - p_retailprice)) AS largest_change,
(SELECT p_partkey FROM part ORDER BY abs(p_size - p_retailprice) DESC, p_partkey LIMIT 1) AS p_partkey FROM r
""")
def ranking_change(t):
    c = select.ranking_change(t("part"), "p_partkey", "p_size", "p_retailprice", 100)
    return c.withColumn("rank_correlation", r6("rank_correlation"))


@query("""
WITH r AS (SELECT DISTINCT l_returnflag AS r, l_partkey AS k FROM lineitem), n AS (SELECT r, count(*) AS n FROM r GROUP BY r),
s AS (SELECT a.r AS run_a, b.r AS run_b, count(*) AS shared FROM r a JOIN r b ON a.k = b.k AND a.r < b.r GROUP BY ALL)
SELECT x.r AS run_a, y.r AS run_b, coalesce(shared, 0) AS shared, round(coalesce(shared, 0) / (x.n + y.n - coalesce(shared, 0)), 9) AS jaccard FROM n x JOIN n y ON x.r < y.r LEFT JOIN s ON run_a = x.r AND run_b = y.r
""")
def run_overlaps(t):
    o = select.run_overlaps(t("lineitem"), "l_returnflag", "l_partkey")
    return o.withColumn("jaccard", F.round("jaccard", 9))


@query("SELECT *, only_a = 0 AND only_b = 0 AS equal, only_a = 0 AS subset FROM (SELECT (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS only_a, (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) AS only_b)")
def set_contract(t):
    return select.sets_equal(t("customer").select("c_custkey"), t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT a.x AS size, b.x AS flag, c.x AS share FROM (SELECT unnest([10, 20, 30]) AS x) a, (SELECT unnest([true, false]) AS x) b, (SELECT unnest(['low', 'high']) AS x) c")
def option_grid(t):
    return quota.option_grid(t("region").sparkSession, size=[10, 20, 30], flag=[True, False], share=["low", "high"])


@query("SELECT first(p_partkey ORDER BY p_retailprice, p_partkey) AS p_partkey, 'eligible' AS how FROM part WHERE p_size > 45 HAVING count(*) > 0 UNION ALL SELECT min(p_partkey), 'default' FROM part HAVING count(*) FILTER (p_size > 45) = 0")
def best_or_default(t):
    return select.best_or_default(t("part"), F.col("p_size") > 45, [F.col("p_retailprice"), F.col("p_partkey")], F.col("p_partkey") == 1).select("p_partkey", "how")


@query(f"""
WITH s AS (SELECT p_partkey, ({AVG_RANK.format(v='p_size')} - 1) / (count(*) OVER () - 1) AS a, ({AVG_RANK.format(v='p_retailprice')} - 1) / (count(*) OVER () - 1) AS b, ({AVG_RANK.format(v='p_partkey')} - 1) / (count(*) OVER () - 1) AS c FROM part),
g AS (SELECT 'a' AS omitted, p_partkey, (b + c) / 2 AS score FROM s UNION ALL SELECT 'b', p_partkey, (a + c) / 2 FROM s UNION ALL SELECT 'c', p_partkey, (a + b) / 2 FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY omitted ORDER BY round(score, 9) DESC, p_partkey) AS n FROM g)
SELECT omitted, p_partkey AS winner, round(score, 9) AS score FROM r WHERE n = 1
""")
def leave_one_model_out(t):
    p = rank.percentile_scores(t("part").select("p_partkey", "p_size", "p_retailprice"), {"a": ("p_size", False), "b": ("p_retailprice", False), "c": ("p_partkey", False)})
    best = rank.leave_one_out(p.select("p_partkey", *[F.round(c, 12).alias(c) for c in "abc"]), "p_partkey", ["a", "b", "c"])
    return best.withColumn("score", F.round("score", 9))


@query(f"SELECT p_partkey, round(1 - ({AVG_RANK.format(v='p_retailprice')} - 1) / (count(*) OVER () - 1), 9) AS score FROM part")
def configured_score(t):
    s = rank.configured_score(t("part"), {"enabled": True, "adopted": "B1", "fallback": "B0"}, {"B0": "p_size", "B1": "p_retailprice"}, "score")
    return s.select("p_partkey", F.round("score", 9).alias("score"))


NAMES = "SELECT p_name AS s, min(p_partkey) AS id FROM part GROUP BY p_name"
KINDS = "SELECT DISTINCT lower(p_type) || ' ' || split_part(p_name, ' ', 2) AS s FROM part"


def _names(t):
    return t("part").groupBy(F.col("p_name").alias("s")).agg(F.min("p_partkey").alias("id"))


def _kinds(t):
    """A second set of whole texts."""
    return t("part").select(F.concat_ws(" ", F.lower("p_type"), F.split_part("p_name", F.lit(" "), F.lit(2))).alias("s")).distinct()


@query(f"""
WITH w AS ({NAMES})
SELECT a.id AS id_a, b.id AS id_b, round({LCS.format(a='a.s', b='b.s')} / greatest(length(a.s), length(b.s))::DOUBLE, 9) AS ratio FROM w a JOIN w b ON a.id < b.id WHERE {LCS.format(a='a.s', b='b.s')} / greatest(length(a.s), length(b.s))::DOUBLE >= 0.6
""")
def identity_pairs(t):
    return joins.similar_pairs(_names(t), _names(t), "s", 0.6, itself=True, measure=kernels.identity).withColumn("ratio", F.round("ratio", 9))


@query(f"""
WITH RECURSIVE w AS ({NAMES}),
e AS (SELECT a.id AS a, b.id AS b FROM w a JOIN w b ON a.id <> b.id WHERE {LCS.format(a='a.s', b='b.s')} / greatest(length(a.s), length(b.s))::DOUBLE >= 0.8), r(id, seen) AS (SELECT id, id FROM w UNION SELECT r.id, e.b FROM r JOIN e ON r.seen = e.a)
SELECT id, min(seen) AS root, sha256(min(seen)::VARCHAR) AS "group" FROM r GROUP BY id
""")
def threshold_components(t):
    pairs = joins.similar_pairs(_names(t), _names(t), "s", 0.8, itself=True, measure=kernels.identity)
    return graph.threshold_components(_names(t).select("id"), pairs, 0.8)


@query(f"""
WITH w AS ({NAMES})
SELECT a.id AS id_a, b.id AS id_b, round(2 * {LCS.format(a='a.s', b='b.s')} / (length(a.s) + length(b.s))::DOUBLE, 9) AS ratio, (a.id + b.id) % 3 = 0 AS known
FROM w a JOIN w b ON a.id < b.id AND a.id % 2 = b.id % 2 WHERE 2 * {LCS.format(a='a.s', b='b.s')} / (length(a.s) + length(b.s))::DOUBLE >= 0.8
""")
def pairs_within_groups(t):
    """Alike names of one group (odd or even), and whether evidence names the pair."""
    names = _names(t).withColumn("odd", F.col("id") % 2)
    ends = names.select(F.col("id").alias("id_a"), F.col("odd").alias("o")), names.select(F.col("id").alias("id_b"), F.col("odd").alias("o"))
    evidence = ends[0].join(ends[1], "o").where("id_a > id_b AND (id_a + id_b) % 3 = 0")
    return joins.pairs_within(names, ["odd"], "s", 0.8, evidence).withColumn("ratio", F.round("ratio", 9))


def alignment_sql(score: str, opening: float, extension: float) -> str:
    """SQL of all pairs of names, aligned letter by letter of the first: tables ``q`` of pairs and ``aligned`` with equal letters and columns.

    One whole number holds score, equal letters and columns, in this order of weight; lists hold a row of each of the three tables.
    """
    new, more, low = int(2 * opening) * align.ROOM + 1, int(2 * extension) * align.ROOM + 1, align.LOW
    points = f"({score}) * {align.ROOM} + (a[i + 1] = b[j])::BIGINT * {align.SAME} - 1"
    return f"""
q AS (SELECT x.id AS id_a, y.id AS id_b, upper(least(x.s, y.s)) AS a, upper(greatest(x.s, y.s)) AS b FROM ({NAMES}) x JOIN ({NAMES}) y ON x.id < y.id),
dp AS (
  SELECT id_a, id_b, a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda j: CASE WHEN j = 0 THEN 0 ELSE {low} END) AS m, list_transform(range(0, length(b) + 1), lambda j: {low}::BIGINT) AS x,
    list_transform(range(0, length(b) + 1), lambda j: CASE WHEN j = 0 THEN {low} ELSE -{new} - (j - 1) * {more} END) AS y FROM q
  UNION ALL
  SELECT id_a, id_b, a, b, i + 1, m, x, list_transform(range(0, length(b) + 1), lambda j: CASE WHEN j = 0 THEN {low} ELSE list_max(list_transform(range(0, j), lambda k: greatest(m[k + 1], x[k + 1]) - {new} - (j - 1 - k) * {more})) END)
  FROM (
    SELECT id_a, id_b, a, b, i, list_transform(range(0, length(b) + 1), lambda j: CASE WHEN j = 0 THEN {low} ELSE greatest(m[j], x[j], y[j]) + {points} END) AS m,
      list_transform(range(0, length(b) + 1), lambda j: greatest(m[j + 1] - {new}, x[j + 1] - {more}, y[j + 1] - {new})) AS x
    FROM dp WHERE i < length(a)
  )
),
ended AS (SELECT id_a, id_b, a, b, ((greatest(m[-1], x[-1], y[-1]) + {align.ROOM // 2}) % {align.ROOM} + {align.ROOM}) % {align.ROOM} - {align.ROOM // 2} AS rest FROM dp WHERE i = length(a)),
aligned AS (SELECT id_a, id_b, a, b, ceil(rest / {align.SAME}.0)::BIGINT AS same, ceil(rest / {align.SAME}.0)::BIGINT * {align.SAME} - rest AS columns FROM ended)"""


_TABLE = "[" + ", ".join(str(2 * v) for row in align.blosum45().tolist() for v in row) + "]"
_PLACE = "(CASE strpos('" + align.LETTERS + "', {c}) WHEN 0 THEN " + str(len(align.LETTERS)) + " ELSE strpos('" + align.LETTERS + "', {c}) - 1 END)"
BLOSUM_SQL = alignment_sql(f"{_TABLE}[{_PLACE.format(c='a[i + 1]')} * {len(align.LETTERS) + 1} + {_PLACE.format(c='b[j]')} + 1]", 5, 1)
PLAIN_SQL = alignment_sql("CASE WHEN a[i + 1] = b[j] THEN 4 ELSE -2 END", 2, 0.5)


@query(f"WITH RECURSIVE {BLOSUM_SQL} SELECT id_a, id_b, round(same / columns::DOUBLE, 9) AS ratio FROM aligned WHERE same / columns::DOUBLE >= 0.5")
def alignment_edges(t):
    """Pairs of whole names with a global identity of at least a half."""
    return joins.aligned_pairs(_names(t).withColumn("s", F.upper("s")), "s", "id", 0.5).withColumn("ratio", F.round("ratio", 9))


@query(f"WITH RECURSIVE {BLOSUM_SQL} SELECT id_a, id_b, round(CASE WHEN id_a % 2 = 0 AND id_b % 2 = 0 THEN 1.0 / (1 + id_b - id_a) ELSE same / columns::DOUBLE END, 9) AS ratio FROM aligned")
def extended_matrix(t):
    """All cells of the whole names' identity matrix, those of even parts known before."""
    names = _names(t).withColumn("s", F.upper("s"))
    even = names.where("id % 2 = 0").select("id")
    known = even.select(F.col("id").alias("id_a")).join(even.select(F.col("id").alias("id_b")), F.col("id_a") > F.col("id_b")).withColumn("ratio", 1 / (1 + F.col("id_a") - F.col("id_b")))
    return joins.extended_matrix(names, known, "id", "s").withColumn("ratio", F.round("ratio", 9))


@query(f"""
WITH RECURSIVE {PLAIN_SQL}, w AS ({NAMES}),
h AS (SELECT id_a, id_b FROM aligned WHERE same >= 0.8 * columns AND length(a) + length(b) - columns >= 0.8 * greatest(length(a), length(b))), e AS (SELECT id_a AS a, id_b AS b FROM h UNION SELECT id_b, id_a FROM h),
r(id, seen) AS (SELECT id, id FROM w UNION SELECT r.id, e.b FROM r JOIN e ON r.seen = e.a)
SELECT id, min(seen) AS root, sha256(min(seen)::VARCHAR) AS "group" FROM r GROUP BY id
""")
def homology_components(t):
    """Components of whole names by the homology test."""
    names = _names(t).withColumn("s", F.upper("s"))
    return graph.threshold_components(names.select("id"), joins.aligned_pairs(names, "s", "id", homologous=True), 0.8)


@query(f"""
WITH RECURSIVE {BLOSUM_SQL}, w AS ({NAMES}), e AS (SELECT id_a AS a, id_b AS b FROM aligned WHERE same / columns::DOUBLE > 0.6 UNION SELECT id_b, id_a FROM aligned WHERE same / columns::DOUBLE > 0.6),
r(id, seen) AS (SELECT id, id FROM w UNION SELECT r.id, e.b FROM r JOIN e ON r.seen = e.a)
SELECT id, min(seen) AS root, sha256(min(seen)::VARCHAR) AS "group" FROM r GROUP BY id
""")
def strict_identity_components(t):
    """Components of whole names with a global identity above 0.6."""
    names = _names(t).withColumn("s", F.upper("s"))
    return graph.threshold_components(names.select("id"), joins.aligned_pairs(names, "s", "id", 0.6), 0.6, strict=True)


@query(f"""
WITH w AS ({NAMES}), r AS ({KINDS})
SELECT w.id, round(max(2 * {LCS.format(a='w.s', b='r.s')} / (length(w.s) + length(r.s))::DOUBLE), 9) AS max_ratio FROM w, r GROUP BY w.id
""")
def max_similarity_of_words(t):
    """Of each whole name, the highest ratio to a second set of texts."""
    return joins.max_similarity(_names(t), _kinds(t), "s", "id").withColumn("max_ratio", F.round("max_ratio", 9))


@query(f"""
WITH w AS ({NAMES}), r AS ({KINDS})
SELECT id FROM w WHERE NOT EXISTS (SELECT 1 FROM r WHERE 2 * {LCS.format(a='w.s', b='r.s')} / (length(w.s) + length(r.s))::DOUBLE > 0.72)
""")
def clear_of_reference(t):
    return joins.clear_of(_names(t), _kinds(t), "s", "id", 0.72).select("id")


@query(f"""
WITH RECURSIVE w AS ({NAMES}), r AS ({KINDS}), h AS (
  SELECT w.id, w.s AS a, r.s AS b, 0 AS i, list_transform(range(0, length(r.s) + 1), lambda j: 0) AS row, 0 AS best FROM w, r
  UNION ALL
  SELECT id, a, b, i + 1, full_row, greatest(best, list_max(full_row))
  FROM (
    SELECT id, a, b, i, best, list_transform(range(0, length(b) + 1), lambda j: list_max(list_transform(range(0, j + 1), lambda k: open_[k + 1] - (j - k)))) AS full_row
    FROM (SELECT *, list_transform(range(0, length(b) + 1), lambda j: CASE WHEN j = 0 THEN 0 ELSE greatest(0, row[j] + CASE WHEN a[i + 1] = b[j] THEN 1 ELSE -1 END, row[j + 1] - 1) END) AS open_ FROM h WHERE i < length(a))
  )
)
SELECT id, round(max(best / greatest(length(a), length(b))::DOUBLE), 9) AS max_ratio FROM h WHERE i = length(a) GROUP BY id
""")
def max_local_alignment(t):
    """Of each whole name, the highest local similarity to a second set of texts."""
    return joins.max_similarity(_names(t), _kinds(t), "s", "id", local=True).withColumn("max_ratio", F.round("max_ratio", 9))


@query("""
WITH RECURSIVE m AS (SELECT p_partkey AS id, 'b' || p_brand || '#' || p_size AS k FROM part UNION ALL SELECT p_partkey, 'n' || p_name FROM part), e AS (SELECT DISTINCT a.id AS a, b.b FROM m a JOIN (SELECT k, min(id) AS b FROM m GROUP BY k) b USING (k) WHERE a.id <> b),
f AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(id, seen) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT r.id, f.b FROM r JOIN f ON r.seen = f.a) SELECT id, min(seen) AS root FROM r GROUP BY id
""")
def joint_components(t):
    p = t("part")
    return graph.joint_components(p.select(F.col("p_partkey").alias("id")), p.select(F.col("p_partkey").alias("id"), F.concat_ws("#", "p_brand", "p_size").alias("key")), p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("key")))


@query("SELECT c_nationkey AS root, CASE max(CASE WHEN c_custkey % 11 = 0 THEN 3 WHEN c_custkey % 5 = 0 THEN 2 ELSE 1 END) WHEN 3 THEN 'used' WHEN 2 THEN 'unknown' ELSE 'fresh' END AS exposure FROM customer GROUP BY 1")
def component_exposure(t):
    label = F.when(F.col("c_custkey") % 11 == 0, "used").when(F.col("c_custkey") % 5 == 0, "odd").otherwise("fresh")
    return graph.exposure(t("customer").select(F.col("c_nationkey").alias("root"), label.alias("exposure")))


@query(None)
def balanced_folds(t):
    """Customers by orders, each to the lightest fold; tested one by one."""
    return graph.balanced_folds(t("orders"), "o_custkey", 5, "42")


@query("""
WITH p AS (SELECT ps.l_suppkey AS a, qs.l_suppkey AS b, count(*) / 10.0 AS ratio FROM lineitem ps JOIN lineitem qs ON ps.l_orderkey = qs.l_orderkey AND ps.l_suppkey < qs.l_suppkey GROUP BY ALL), s AS (SELECT a, b, ratio FROM p UNION ALL SELECT b, a, ratio FROM p)
SELECT s_suppkey AS id, (s_suppkey % 5)::INT AS fold, coalesce(max(ratio), 0.0) AS max_ratio, coalesce(max(ratio), 0.0) > 0.1 AS violates FROM supplier LEFT JOIN s ON a = s_suppkey AND a % 5 <> b % 5 GROUP BY s_suppkey
""")
def max_to_other_folds(t):
    l = graph.dealt(t("lineitem").select("l_orderkey", "l_suppkey"), "l_orderkey")
    other = l.withColumnRenamed("l_suppkey", "s2")
    pairs = l.join(other, "l_orderkey").where("l_suppkey < s2").groupBy(F.col("l_suppkey").alias("id_a"), F.col("s2").alias("id_b")).agg((F.count("*") / 10.0).alias("ratio"))
    return graph.max_to_other_folds(pairs, t("supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 5).cast("int").alias("fold")), 0.1)


@query("SELECT (o_orderkey % 7)::BIGINT AS part_a, (l_suppkey % 7)::BIGINT AS part_b, count(*) AS n FROM (SELECT least(o_orderkey % 7, l_suppkey % 7) AS o_orderkey, greatest(o_orderkey % 7, l_suppkey % 7) AS l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 7 <> l_suppkey % 7) GROUP BY ALL")
def cross_partition_pairs(t):
    pairs = t("lineitem").select(F.col("l_orderkey").alias("id_a"), (F.col("l_suppkey") + 1_000_000_000).alias("id_b"))
    own = t("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 7).alias("part"))
    sup = t("lineitem").select("l_suppkey").distinct().select((F.col("l_suppkey") + 1_000_000_000).alias("id"), (F.col("l_suppkey") % 7).alias("part"))
    return select.cross_partition_pairs(pairs, own.unionByName(sup), "id", "part")


@query("SELECT c_custkey FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE m IS NULL OR m <= 250000")
def quarantine(t):
    pairs = t("orders").select(F.col("o_custkey").alias("id_a"), F.col("o_totalprice").alias("ratio"))
    return select.quarantine(t("customer").select("c_custkey"), pairs, "c_custkey", 250000.0)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN n = 1 THEN 'single' WHEN k < n THEN 'unresolved' WHEN d = 1 THEN 'same_assay' ELSE 'distinct' END AS status FROM (SELECT l_orderkey, l_linenumber, count(*) OVER w AS n, count(a) OVER w AS k, len(list_distinct(list(a) OVER w)) AS d FROM (SELECT *, CASE WHEN l_quantity > 5 THEN l_returnflag END AS a FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey, l_linestatus))")
def duplicate_links(t):
    l = t("lineitem").withColumn("a", F.when(F.col("l_quantity") > 5, F.col("l_returnflag")))
    return graph.duplicate_links(l, ["l_orderkey", "l_linestatus"], "a").select("l_orderkey", "l_linenumber", "status")


@query("""
WITH e AS (SELECT p_name AS name, min(p_partkey) AS g FROM part WHERE p_size > 25 GROUP BY 1), s AS (SELECT array_to_string(string_split(p_name, ' ')[1:2], ' ') AS name, min(p_partkey) AS g FROM part WHERE p_size < 10 GROUP BY 1)
SELECT p_partkey, coalesce(e.g, s.g) AS genome, CASE WHEN e.g IS NOT NULL THEN 'exact' WHEN s.g IS NOT NULL THEN 'species' ELSE 'unknown' END AS how FROM part LEFT JOIN e ON e.name = p_name LEFT JOIN s ON s.name = array_to_string(string_split(p_name, ' ')[1:2], ' ')
""")
def resolved_labels(t):
    p = t("part")
    exact = p.where("p_size > 25").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("genome"))
    species = p.where("p_size < 10").groupBy(text.species(F.col("p_name")).alias("name")).agg(F.min("p_partkey").alias("genome"))
    return graph.resolve_label(p, "p_name", exact, species).select("p_partkey", "genome", "how")


@query("SELECT DISTINCT l_orderkey, l_linestatus, (l_orderkey % 9) / 8.0::DOUBLE + (l_linestatus = 'O')::INT / 4.0::DOUBLE AS mean FROM lineitem")
def consistent_values(t):
    return select.consistent(t("lineitem").withColumn("v", F.col("l_orderkey") % 9 / 8 + (F.col("l_linestatus") == "O").cast("int") / 4 + F.col("l_linenumber") / 1e9), ["l_orderkey", "l_linestatus"], "v").withColumn("mean", r6("mean"))


@query("SELECT l_partkey, count(DISTINCT l_returnflag) AS folds FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def leaking_groups(t):
    return graph.leaks(t("lineitem"), "l_partkey", "l_returnflag")


@query("""
SELECT c_custkey AS id, (c_nationkey + 1) % 3 <> 1 AS training, (c_nationkey + 1) % 3 = 1 AS validation FROM customer
""")
def held_fold_masks(t):
    c = t("customer").select(F.col("c_custkey").alias("id"), "c_nationkey", ((F.col("c_nationkey") + 1) % 3).alias("fold"))
    return measure.fold_masks(c, "fold", "c_nationkey", 1).select("id", "training", "validation")


@query("SELECT p_brand AS run, count(*) AS raw, count(*) FILTER (p_size > 10) AS valid, count(DISTINCT CASE WHEN p_size > 10 THEN p_name END) AS unique_valid, count(*) FILTER (p_size BETWEEN 11 AND 30) AS common_valid, count(DISTINCT CASE WHEN p_size BETWEEN 11 AND 30 THEN p_name END) AS common_unique FROM part GROUP BY 1")
def screen_tally(t):
    return aggregate.screen_tally(t("part"), "p_brand", "p_name", F.col("p_size") > 10, F.col("p_size") <= 30).withColumnRenamed("p_brand", "run")


@query("""
WITH k AS (SELECT DISTINCT p_name AS t FROM part WHERE p_size > 40), r AS (SELECT p_brand AS run, p_name, p_retailprice AS v, t IS NULL AS new, p_size < 25 AS common FROM part LEFT JOIN k ON t = p_name), s AS (SELECT *, 'native' AS scope FROM r UNION ALL SELECT *, 'common' FROM r WHERE common)
SELECT run, scope, count(*) AS n, count(DISTINCT p_name) AS distinct_n, count(DISTINCT CASE WHEN new THEN p_name END) AS novel, count(v) / count(*) AS coverage, round(quantile_cont(v, 0.5), 6) AS median FROM s GROUP BY ALL
""")
def cohort_metrics(t):
    p = t("part")
    m = aggregate.cohort_metrics(p, "p_brand", "p_name", "p_retailprice", F.col("p_size") < 25, p.where("p_size > 40"))
    return m.withColumnRenamed("p_brand", "run").withColumn("median", r6("median"))


#: Local alignment of every two names, scores by letter of the first; ``near`` has the similarity of each pair.
NEAR = f"""
g AS (SELECT id, p.s, v FROM ({NAMES}) p JOIN (SELECT p_name AS s, min(p_retailprice) AS v FROM part GROUP BY 1) USING (s)),
h AS (
  SELECT x.id AS id_a, y.id AS id_b, x.s AS a, y.s AS b, 0 AS i, list_transform(range(0, length(y.s) + 1), lambda j: 0) AS row, 0 AS best FROM g x JOIN g y ON x.id < y.id
  UNION ALL
  SELECT id_a, id_b, a, b, i + 1, full_row, greatest(best, list_max(full_row))
  FROM (
    SELECT id_a, id_b, a, b, i, best, list_transform(range(0, length(b) + 1), lambda j: list_max(list_transform(range(0, j + 1), lambda k: open_[k + 1] - (j - k)))) AS full_row
    FROM (SELECT *, list_transform(range(0, length(b) + 1), lambda j: CASE WHEN j = 0 THEN 0 ELSE greatest(0, row[j] + CASE WHEN a[i + 1] = b[j] THEN 1 ELSE -1 END, row[j + 1] - 1) END) AS open_ FROM h WHERE i < length(a))
  )
),
near AS (SELECT id_a, id_b, best / greatest(length(a), length(b))::DOUBLE AS ratio FROM h WHERE i = length(a))"""


def _priced_names(t):
    return t("part").groupBy(F.col("p_name").alias("s")).agg(F.min("p_partkey").alias("id"), F.min("p_retailprice").alias("v"))


@query(f"""
WITH w AS ({NAMES}), r AS ({KINDS})
SELECT id, row_number() OVER (ORDER BY s DESC) AS place FROM w WHERE NOT EXISTS (SELECT 1 FROM r WHERE 2 * {LCS.format(a='w.s', b='r.s')} / (length(w.s) + length(r.s))::DOUBLE > 0.72) ORDER BY s DESC LIMIT 10
""")
def first_clear_names(t):
    """The first ten whole names, from the last in the alphabet, that are clear of a second set of texts."""
    got = prefix.clear_first(_names(t), "id", "s", [("s", False)], _kinds(t), 0.72, 10, first=8)
    return got.select("id", F.row_number().over(W.orderBy(F.desc("s"))).cast("long").alias("place"))  # ten rows


@query(f"""
WITH RECURSIVE {NEAR},
o AS (SELECT id, v, row_number() OVER (ORDER BY v, id) AS n, coalesce((SELECT list(CASE WHEN id_a = id THEN id_b ELSE id_a END) FROM near WHERE (id_a = id OR id_b = id) AND ratio > 0.4), []) AS close FROM g WHERE id % 5 > 0),
p AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS taken UNION ALL SELECT o.n, CASE WHEN len(taken) = 6 OR len(list_intersect(taken, close)) > 0 THEN taken ELSE list_append(taken, o.id) END FROM p JOIN o ON o.n = p.n + 1)
SELECT id, place, v <= 905 AS within FROM (SELECT unnest(taken) AS id, generate_subscripts(taken, 1) AS place FROM (SELECT taken FROM p ORDER BY n DESC LIMIT 1)) JOIN g USING (id)
""")
def starter_names(t):
    """Six whole names by price, no two alike above 0.4; every fifth part is a known reference, so its own name is not taken."""
    names = graph.cut(_priced_names(t))  # every prefix reads it again
    fifth = names.where("id % 5 = 0")
    got = prefix.starter_top(names, "id", "s", "v", fifth.limit(0), fifth, 6, known_max=0.999, within=905.0, first=8)
    return got.select("id", F.col("place").cast("long").alias("place"), "within")


@query(f"""
WITH RECURSIVE {NEAR},
o AS (SELECT id, row_number() OVER (ORDER BY v DESC, id) AS n, coalesce((SELECT list(CASE WHEN id_a = id THEN id_b ELSE id_a END) FROM near WHERE (id_a = id OR id_b = id) AND ratio > 0.5), []) AS close,
  id IN (SELECT p_partkey FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1 HAVING avg(l_discount) <= 0.051) AS good FROM g),
p AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS taken UNION ALL SELECT o.n, CASE WHEN NOT good OR len(taken) = 4 OR len(list_intersect(taken, close)) > 0 THEN taken ELSE list_append(taken, o.id) END FROM p JOIN o ON o.n = p.n + 1)
SELECT unnest(taken) AS id, generate_subscripts(taken, 1) AS place FROM (SELECT taken FROM p ORDER BY n DESC LIMIT 1)
""")
def screened_names(t):
    """Four whole names from the highest price, no two alike above 0.5, screened by the mean discount of their lines."""

    def screen(part):
        lines = t("lineitem").join(part.select(F.col("id").alias("l_partkey")), "l_partkey")
        return lines.groupBy(F.col("l_partkey").alias("id")).agg((F.avg("l_discount") > 0.051).alias("rejected"))

    got = prefix.screened_top(_priced_names(t), "id", "s", "v", "id", screen, 4, [greedy.Step(2000, pairwise=0.5)], {}, first=16)
    return got.select("id", F.col("place").cast("long").alias("place"))


@query(f"""
WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS v0, {", ".join(f"list_sum(embedding[{7 * i - 5}:{7 * i + 1}]::DOUBLE[]) / 7 AS v{i}" for i in range(1, 6))} FROM embeddings),
r AS (SELECT vec_id, count(*) OVER () AS n, {", ".join(f"{AVG_RANK.format(v=f'v{i}')} AS r{i}" for i in range(6))} FROM e)
SELECT vec_id, round(((r0 - 1) + {" + ".join(f"(n - r{i})" for i in range(1, 6))}) / (n - 1) / 6.0, 9) AS score FROM r
""")
def consensus_of_six(t):
    """The mean of six percentile scores: a vote's and those of five predictors of seven numbers."""
    parts = {f"p{i}": F.slice("embedding", 7 * i - 5, 7) for i in range(1, 6)}
    rows = t("embeddings").select("vec_id", F.get("embedding", F.lit(0)).alias("vote"), *[c.alias(n) for n, c in parts.items()])
    return rank.consensus_rank(rows, "vote", dict.fromkeys(parts, 7), "score").select("vec_id", F.round("score", 9).alias("score"))
