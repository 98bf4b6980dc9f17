"""Queries of fitted models and of comparisons between sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import seq
from ..operators import compare, minibatch, regress, ridge
from ..operators.graph import cut
from ..sources import bundles
from .catalog import query, r6

STEPS, ALPHA = 20, 0.05


def _step(i: int, weight: str, gradient: str) -> str:
    """Adam's update of one weight, as columns."""
    m, v = f"({regress.BETA_1} * m{i} + {1 - regress.BETA_1} * ({gradient}))", f"({regress.BETA_2} * v{i} + {1 - regress.BETA_2} * ({gradient}) * ({gradient}))"
    new = f"{weight} - {regress.RATE} * ({m} / (1 - power({regress.BETA_1}, t + 1))) / (sqrt({v} / (1 - power({regress.BETA_2}, t + 1))) + {regress.TINY})"
    return f"{new} AS {weight}, {m} AS m{i}, {v} AS v{i}"


@query(f"""
WITH RECURSIVE r AS (SELECT l_quantity AS a, l_discount AS b, CASE WHEN l_returnflag <> 'A' THEN log2(l_extendedprice) END AS lo, CASE WHEN l_returnflag <> 'R' THEN log2(l_extendedprice) END AS hi, 1.0 / count(*) OVER (PARTITION BY l_orderkey) AS w FROM lineitem),
x AS (SELECT (a - (SELECT avg(a) FROM r)) / (SELECT stddev_pop(a) FROM r) AS a, (b - (SELECT avg(b) FROM r)) / (SELECT stddev_pop(b) FROM r) AS b, coalesce(lo, '-inf'::DOUBLE) AS lo, coalesce(hi, 'inf'::DOUBLE) AS hi, w / (SELECT sum(w) FROM r) AS w FROM r),
f AS (
  SELECT 0 AS t, 0.0::DOUBLE AS wa, 0.0::DOUBLE AS m1, 0.0::DOUBLE AS v1, 0.0::DOUBLE AS wb, 0.0::DOUBLE AS m2, 0.0::DOUBLE AS v2, (SELECT median(coalesce(lo, hi)) FROM r) AS wc, 0.0::DOUBLE AS m3, 0.0::DOUBLE AS v3, 0.0::DOUBLE AS loss
  UNION ALL
  SELECT t + 1, {_step(1, 'wa', f'ga + {2 * ALPHA} * wa / 2')}, {_step(2, 'wb', f'gb + {2 * ALPHA} * wb / 2')}, {_step(3, 'wc', 'gc')}, l + {ALPHA} * (wa * wa + wb * wb) / 2
  FROM (
    SELECT t, wa, m1, v1, wb, m2, v2, wc, m3, v3, sum(w * d * a) AS ga, sum(w * d * b) AS gb, sum(w * d) AS gc, sum(w * d * d / 4) AS l
    FROM (SELECT f.*, a, b, w, 2 * (greatest(wc + wa * a + wb * b - hi, 0) - greatest(lo - (wc + wa * a + wb * b), 0)) AS d FROM f, x WHERE t < {STEPS})
    GROUP BY t, wa, m1, v1, wb, m2, v2, wc, m3, v3
  )
)
SELECT round(wa, 6) AS quantity, round(wb, 6) AS discount, round(wc, 6) AS intercept, round(loss, 6) AS loss FROM f WHERE t = {STEPS}
""")
def interval_fit(t):
    """Squared distance to bounds: prices known exactly, from below or from above; rows of an order weigh one together."""
    fit = regress.fit_intervals(_priced(t), ["l_quantity", "l_discount"], "low", "high", "l_orderkey", alpha=ALPHA, steps=STEPS)
    (a, b), c = fit.coefficients[""], fit.intercept[""]
    return t("lineitem").limit(1).select(*[F.round(F.lit(float(v)), 6).alias(n) for n, v in (("quantity", a), ("discount", b), ("intercept", c), ("loss", fit.losses[-1]))])


def _priced(t):
    price = F.log2("l_extendedprice")
    return t("lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_linestatus", F.when(F.col("l_returnflag") != "A", price).alias("low"), F.when(F.col("l_returnflag") != "R", price).alias("high"))


@query(None)
def censored_normal_fit(t):
    """Means and scales by line status under the normal likelihood of bounds; tested against numeric derivatives and planted values."""
    rows = _priced(t)
    fit = regress.fit_intervals(rows, ["l_quantity", "l_discount"], "low", "high", head="l_linestatus", loss="normal", alpha=ALPHA, steps=STEPS, rate=0.1)
    got = regress.predict(rows, fit, "l_linestatus", deviation="sd")
    return got.groupBy("l_linestatus").agg(r6(F.avg("predicted")).alias("mean"), r6(F.avg("sd")).alias("sd"), F.count("*").alias("n"))


#: Vectors of odd labels are compared with those of even ones.
SETS = "v AS (SELECT vec_id, label % 2 AS s, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL), d AS (SELECT a.vec_id AS a, b.vec_id AS b, a.s AS sa, b.s AS sb, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id)"


def _sets(t):
    v = t("embeddings")
    return v.where("label % 2 = 1"), v.where("label % 2 = 0")


@query(f"""
WITH {SETS}, r AS (SELECT a, d AS radius FROM d WHERE sa = sb QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) = 5),
c AS (SELECT d.a, d.sa, max((d.d <= r.radius)::INT) AS inside FROM d JOIN r ON d.b = r.a WHERE sa <> sb GROUP BY d.a, d.sa)
SELECT round(avg(inside) FILTER (sa = 1), 9) AS precision, round(avg(inside) FILTER (sa = 0), 9) AS recall FROM c
""")
def set_coverage(t):
    """Precision and recall of the vectors of odd labels against those of even labels."""
    got = compare.coverage(*_sets(t), "vec_id", "embedding")
    return got.select(*[F.round(c, 9).alias(c) for c in got.columns])


@query(f"""
WITH {SETS}, r AS (SELECT a, min(d) AS radius FROM d WHERE sa = 0 AND sb = 0 GROUP BY a), n AS (SELECT a, d, b FROM d WHERE sa = 1 AND sb = 0 QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) = 1)
SELECT round(avg((d > radius)::INT), 9) AS authenticity FROM n JOIN r ON n.b = r.a
""")
def authentic_share(t):
    return compare.authenticity(*_sets(t), "vec_id", "embedding").select(F.round("authenticity", 9).alias("authenticity"))


FEATURES, BANDWIDTH = 16, 0.7
_W = "[" + ", ".join("[" + ", ".join(map(repr, column)) + "]" for column in compare.fourier_weights(64, FEATURES, BANDWIDTH, 42).T.tolist()) + "]"


@query(f"""
WITH z AS (SELECT list_transform({_W}, lambda w: list_inner_product(w, embedding::DOUBLE[])) AS z FROM embeddings WHERE embedding IS NOT NULL),
f AS (SELECT list_concat(list_transform(z, lambda x: cos(x)), list_transform(z, lambda x: sin(x))) AS f FROM z)
SELECT round(count(*) * {FEATURES * FEATURES} / sum(list_inner_product(a.f, b.f) ** 2), 6) AS modes FROM f a, f b
""")
def kernel_modes(t):
    """How many modes all vectors have; in SQL over all pairs of rows."""
    modes = compare.kernel_entropy(t("embeddings"), "embedding", 64, BANDWIDTH, FEATURES)
    return t("embeddings").limit(1).select(F.round(F.lit(modes), 6).alias("modes"))


#: Net charge and mean hydropathy of a name's letters.
_COUNT = "(length(p_name) - length(replace(p_name, '{c}', '')))"
CHARGE_SQL = f"{_COUNT.format(c='k')} + {_COUNT.format(c='r')} - {_COUNT.format(c='d')} - {_COUNT.format(c='e')}"
GRAVY_SQL = "list_sum(list_filter(list_transform(string_split(upper(p_name), ''), lambda c: map_extract(MAP {" + ", ".join(f"'{c}': {v}" for c, v in seq.HYDROPATHY.items()) + "}, c)[1]), lambda x: x IS NOT NULL)) / length(p_name)"
_KL = "(SELECT round(sum(p / sp * ln((p / sp) / (q / sq))), 9) FROM (SELECT p, q, sum(p) OVER () AS sp, sum(q) OVER () AS sq FROM (SELECT 1.0 + count(*) FILTER (own = 1) AS p, 1.0 + count(*) FILTER (own = 0) AS q FROM s WHERE {v} IS NOT NULL GROUP BY floor({v} / {w})))) AS {n}"


@query(f"""
WITH s AS (SELECT p_size % 2 AS own, length(p_name) AS l, {CHARGE_SQL} AS c, {GRAVY_SQL} AS g FROM part)
SELECT {_KL.format(v='l', w='1.0', n='length_kl')}, {_KL.format(v='c', w='1.0', n='charge_kl')}, {_KL.format(v='round(g, 6)', w='0.25', n='gravy_kl')}
""")
def histogram_divergences(t):
    """Length, charge and hydropathy of names of odd sizes against those of even sizes."""
    own, other = (t("part").where(f"p_size % 2 = {k}") for k in (1, 0))
    values = {"length_kl": (F.length("p_name"), 1.0), "charge_kl": (F.expr(CHARGE_SQL), 1.0), "gravy_kl": (F.round(seq.scale_mean(F.upper("p_name"), seq.HYDROPATHY), 6), 0.25)}
    parts = [compare.histogram_kl(own, other, v, w).select(F.round("kl", 9).alias(n)) for n, (v, w) in values.items()]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # one row each


@query("""
WITH r AS (SELECT p_name AS t, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n FROM part), d AS (SELECT r.t, (i + 1 + ('0x' || substr(sha256('42:' || i || ':' || j), 1, 15))::BIGINT % (n - 1)) % n AS o FROM r, range(5) g(j))
SELECT round(avg(levenshtein(d.t, r.t) / greatest(length(d.t), length(r.t))::DOUBLE), 9) AS diversity FROM d JOIN r ON d.o = r.i
""")
def name_diversity(t):
    return compare.diversity(t("part"), "p_partkey", "p_name").select(F.round("diversity", 9).alias("diversity"))


@query("""
WITH c AS (SELECT doc_id, lang, floor(ln(1 + length(text)) / 0.25)::BIGINT AS x, floor(ln(1 + length(text) - length(regexp_replace(text, '[0-9]', '', 'g'))) / 0.25)::BIGINT AS y, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 15))::BIGINT % 5 AS fold FROM documents WHERE text IS NOT NULL),
ref AS (SELECT x, y, fold, count(*) AS n FROM c WHERE lang = 'en' GROUP BY ALL), own AS (SELECT x, y, count(*) AS n FROM c WHERE lang <> 'en' GROUP BY ALL),
asked AS (SELECT x, y, t, sum(cal) AS cal, sum(new) AS new FROM (SELECT x, y, fold AS t, n AS cal, 0 AS new FROM ref UNION ALL SELECT x, y, t, 0, n FROM own, range(5) g(t)) GROUP BY ALL),
den AS (SELECT a.x, a.y, a.t, a.cal, a.new, round(coalesce(sum(r.n * exp(-((a.x - r.x) ** 2 + (a.y - r.y) ** 2) * 0.0625 / 0.5)), 0), 9) AS d FROM asked a LEFT JOIN ref r ON r.fold <> a.t AND abs(a.x - r.x) <= 8 AND abs(a.y - r.y) <= 8 GROUP BY ALL),
p AS (SELECT a.t, sum(a.new * (1 + (SELECT coalesce(sum(b.cal), 0) FROM den b WHERE b.t = a.t AND b.d <= a.d)) / (1 + (SELECT sum(b.cal) FROM den b WHERE b.t = a.t))) / sum(a.new) AS p FROM den a GROUP BY a.t)
SELECT round(avg(p), 9) AS conformity FROM p
""")
def length_conformity(t):
    """Conformal p-values of other languages' documents by length and digits, under a density of the English ones."""
    digits = F.length("text") - F.length(F.regexp_replace("text", "[0-9]", ""))
    rows = t("documents").where("text IS NOT NULL").select("doc_id", "lang", F.log1p(F.length("text").cast("double")).alias("a"), F.log1p(digits.cast("double")).alias("b"))
    got = compare.conformity(rows.where("lang <> 'en'"), rows.where("lang = 'en'"), "doc_id", ["a", "b"], 0.25, 0.5, reach=8)
    return got.select(F.round("conformity", 9).alias("conformity"))


PENALTIES = [1.0, 300.0, 30000.0]


@query(f"""
WITH r AS (SELECT l_orderkey % 4 AS f, l_returnflag AS h, l_quantity AS a, l_discount AS b, l_extendedprice AS y FROM lineitem),
g AS (SELECT f, h, count(*) AS n, sum(a) AS sa, sum(b) AS sb, sum(y) AS sy, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS yb FROM r GROUP BY f, h),
s AS (SELECT o, i, h, sum(n) AS n, sum(sa) / sum(n) AS ma, sum(sb) / sum(n) AS mb, sum(sy) / sum(n) AS my, sum(aa) AS aa, sum(ab) AS ab, sum(bb) AS bb, sum(ay) AS ay, sum(yb) AS yb FROM g, range(4) x(o), range(4) y(i) WHERE f <> o AND f <> i GROUP BY o, i, h),
z AS (SELECT *, sqrt(aa / n - ma * ma) AS da, sqrt(bb / n - mb * mb) AS db FROM s),
e AS (SELECT o, i, h, p, ma, mb, my, da, db, (aa - n * ma * ma) / (da * da) + p AS zaa, (bb - n * mb * mb) / (db * db) + p AS zbb, (ab - n * ma * mb) / (da * db) AS zab, (ay - n * ma * my) / da AS zay, (yb - n * mb * my) / db AS zby FROM z, (SELECT unnest({PENALTIES}) AS p)),
m AS (SELECT o, i, h, p, (zay * zbb - zby * zab) / (zaa * zbb - zab * zab) / da AS wa, (zby * zaa - zay * zab) / (zaa * zbb - zab * zab) / db AS wb, my - wa * ma - wb * mb AS c FROM e),
q AS (SELECT o, p, f, avg(mae) AS mae FROM (SELECT m.o, m.p, r.f, r.h, avg(abs(y - (a * wa + b * wb + c))) AS mae FROM r JOIN m ON m.i = r.f AND m.h = r.h AND m.o <> m.i GROUP BY ALL) GROUP BY o, p, f),
best AS (SELECT o, p FROM (SELECT o, p, avg(mae) AS mae FROM q GROUP BY o, p) QUALIFY row_number() OVER (PARTITION BY o ORDER BY mae, p) = 1)
SELECT o::INT AS outer_fold, p::DOUBLE AS penalty, round(avg(mae), 6) AS macro_mae FROM (SELECT o, p, r.h, avg(abs(y - (a * wa + b * wb + c))) AS mae FROM best JOIN m USING (o, p) JOIN r ON m.i = m.o AND r.f = m.o AND r.h = m.h GROUP BY ALL) GROUP BY o, p
""")
def nested_ridge(t):
    """Prices by a head for each return flag; each outer fold is scored once, by the penalty that its inner folds chose."""
    rows = t("lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("key"), (F.col("l_orderkey") % 4).alias("fold"), "l_returnflag", "l_quantity", "l_discount", "l_extendedprice")
    report, _ = ridge.nested_ridge(rows, "key", ["l_quantity", "l_discount"], "l_extendedprice", "fold", "l_returnflag", PENALTIES)
    return report.select(F.col("outer").alias("outer_fold"), "penalty", r6("macro_mae").alias("macro_mae"))


@query("""
WITH e AS (SELECT vec_id, label, label % 2 AS v, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
s AS (SELECT v, i, avg(x) AS m, stddev_pop(x) AS d FROM e GROUP BY ALL), c AS (SELECT v, label, i, avg((x - m) / d) AS c FROM e JOIN s USING (v, i) GROUP BY ALL),
n AS (SELECT label, sum(c * c) / 2 AS half FROM c GROUP BY label), z AS (SELECT vec_id, v, i, (x - m) / d AS x FROM e JOIN s USING (v, i)),
h AS (SELECT vec_id, c.label, sum(x * c) - any_value(half) AS score FROM z JOIN c USING (v, i) JOIN n ON n.label = c.label GROUP BY vec_id, c.label)
SELECT vec_id, 'class ' || label AS name, round(score, 6) AS score FROM h WHERE label > 1 UNION ALL SELECT vec_id, 'shifted ' || label, round(score + 1, 6) FROM h
""")
def bundle_scores(t):
    """Heads of nearest centroids, a bundle for even and one for odd labels, checked and applied to the rows that name them."""
    rows = t("embeddings").where("embedding IS NOT NULL AND label IS NOT NULL").withColumn("version", F.col("label") % 2)
    x = rows.select("version", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    scales = x.groupBy("version", "i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("d"))
    means = x.groupBy("version", "label", "i").agg(F.avg("x").alias("c")).join(scales, ["version", "i"])
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("i", c.alias("c")))), lambda v: v["c"])
    coef = means.groupBy("version", "label").agg(in_order((F.col("c") - F.col("m")) / F.col("d")).alias("c"))
    half = F.aggregate("c", F.lit(0.0), lambda a, v: a - v * v / 2)
    head, member = F.concat(F.lit("class "), F.col("label").cast("string")), F.concat(F.lit("shifted "), F.col("label").cast("string"))
    heads = coef.groupBy("version").agg(F.collect_list(F.struct(head.alias("name"), F.col("c").alias("coef"), half.alias("intercept"), (F.col("label") > 1).alias("supported"))).alias("heads"), F.collect_list(F.struct(member.alias("name"), head.alias("head"), F.lit(1.0).alias("offset"), F.lit(True).alias("supported"))).alias("members"))
    made = scales.groupBy("version").agg(in_order(F.col("m")).alias("mean"), in_order(F.col("d")).alias("scale")).join(heads, "version").withColumn("dataset", F.sha2(F.to_json("heads"), 256))
    scored = bundles.score(rows, bundles.checked(cut(bundles.packed(made))), "version", "embedding")
    return scored.select("vec_id", F.explode("scores").alias("name", "score")).where("score IS NOT NULL").withColumn("score", r6("score"))


@query(None)
def minibatch_clusters(t):
    """Rows and mean label of mini-batch clusters of all vectors; distances, starts and repeats are tested."""
    e = t("embeddings")
    fit = minibatch.fit(e, "vec_id", "embedding", 8, starts=10, steps=10, batch=512)
    return minibatch.predict(e, "embedding", fit).groupBy("cluster").agg(F.count("*").alias("n"), r6(F.avg("label")).alias("mean_label"))
