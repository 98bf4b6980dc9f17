"""Queries of the column functions: sequences, physico-chemistry, texts, reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import physchem, seq, text
from ..operators import aggregate, measure
from ..operators.graph import spread
from .catalog import query, r6

#: Part names as sequences: the letters of the twenty-letter alphabet that they hold.
PART = "(SELECT p_partkey, regexp_replace(upper(p_name), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS s FROM part)"


def parts(t):
    return t("part").select("p_partkey", F.regexp_replace(F.upper("p_name"), f"[^{seq.LETTERS}]", "").alias("s"))


def _scale(table: dict[str, float]) -> str:
    return " + ".join(f"(length(s) - length(replace(s, '{c}', ''))) * {v}" for c, v in table.items())


def _turned(f: str) -> str:
    pairs = ", ".join(f"'{k}': {v}" for k, v in physchem.EISENBERG.items())
    return f"list_sum(list_transform(range(1, length(s) + 1), lambda i: map_extract(MAP {{{pairs}}}, s[i])[1] * {f}(radians((i - 1) * 100.0))))"


_CHARGE = " ".join(
    [f"+ (length(s) - length(replace(s, '{c}', ''))) / (1 + pow(10.0, 7.4 - {pk}))" for c, pk in physchem.POSITIVE.items()]
    + [f"- (length(s) - length(replace(s, '{c}', ''))) / (1 + pow(10.0, {pk} - 7.4))" for c, pk in physchem.NEGATIVE.items()]
)
_N_END = "CASE s[1] " + " ".join(f"WHEN '{c}' THEN {v}" for c, v in physchem.N_END_OF.items()) + f" ELSE {physchem.N_END} END"
_C_END = "CASE s[-1] " + " ".join(f"WHEN '{c}' THEN {v}" for c, v in physchem.C_END_OF.items()) + f" ELSE {physchem.C_END} END"


@query(f"""
SELECT p_partkey, length(s)::DOUBLE AS length, round(1 / (1 + pow(10.0, 7.4 - {_N_END})) - 1 / (1 + pow(10.0, {_C_END} - 7.4)) {_CHARGE}, 6) AS charge, round(({_scale(seq.HYDROPATHY)}) / length(s), 6) AS gravy,
round(sqrt(pow({_turned('cos')}, 2) + pow({_turned('sin')}, 2)) / length(s), 6) AS moment, round(({_scale({'F': 1, 'W': 1, 'Y': 1})}) / length(s), 6) AS aromaticity, round(({_scale(physchem.BOMAN)}) / length(s), 6) AS boman,
round(({_scale(physchem.MASS)} - (length(s) - 1) * {physchem.WATER})::DOUBLE, 6) AS mass, (length(s) - length(replace(s, 'C', '')))::DOUBLE AS cysteines FROM {PART} WHERE s <> ''
""")
def feature_vector(t):
    f = physchem.features(F.col("s"))
    return parts(t).where("s <> ''").select("p_partkey", *[r6(f[n]).alias(n) for n in ("length", "charge", "gravy", "moment", "aromaticity", "boman", "mass", "cysteines")])


@query(None)
def developability(t):
    """Scores, classes and hard-filter reasons of part names; the sections are tested against a plain form."""
    d = physchem.developability(spread(parts(t).where("length(s) >= 2")).withColumn("instability", F.lit(None).cast("double")), "s")
    return d.select("p_partkey", r6("developability").alias("score"), "class", F.array_join("reasons", ",").alias("reasons"), "aggregation", "hemolysis", "proteolysis", "difficulty", r6("isoelectric_point").alias("isoelectric_point"))


@query("""
WITH q AS (SELECT f AS feature, quantile_cont(v, [0.005, 0.01, 0.25, 0.5, 0.75, 0.99, 0.995]) AS q FROM (SELECT 'l_quantity' AS f, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem) GROUP BY f)
SELECT feature, round(q[1], 3) AS q0, round(q[2], 3) AS q1, round(q[3], 3) AS q2, round(q[4], 3) AS q3, round(q[5], 3) AS q4, round(q[6], 3) AS q5, round(q[7], 3) AS q6 FROM q
""")
def reference_statistics(t):
    q = aggregate.reference_statistics(t("lineitem"), ["l_quantity", "l_extendedprice"])
    return q.select("feature", *[F.round(c, 3).alias(c) for c in q.columns[1:]])


@query("""
WITH s AS (SELECT quantile_cont(l_quantity, [0.005, 0.25, 0.5, 0.75, 0.995]) AS a, quantile_cont(l_extendedprice, [0.005, 0.25, 0.5, 0.75, 0.995]) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, round((abs(greatest(-10, least(10, (l_quantity - a[3]) / greatest(a[4] - a[2], 1e-6)))) + abs(greatest(-10, least(10, (l_extendedprice - b[3]) / greatest(b[4] - b[2], 1e-6))))) / 2, 6) AS ood,
((l_quantity < a[1] OR l_quantity > a[5])::INT + (l_extendedprice < b[1] OR l_extendedprice > b[5])::INT) AS n_extreme, (l_quantity < a[1] OR l_quantity > a[5])::INT + (l_extendedprice < b[1] OR l_extendedprice > b[5])::INT >= 1 AS hard_reject FROM lineitem, s
""")
def robust_scores(t):
    l = t("lineitem")
    out = aggregate.robust_scores(l, ["l_quantity", "l_extendedprice"], aggregate.reference_statistics(l, ["l_quantity", "l_extendedprice"]), extreme=1)
    return out.select("l_orderkey", "l_linenumber", r6("ood").alias("ood"), "n_extreme", "hard_reject")


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, CASE l_linenumber % 5 WHEN 0 THEN ' µg / mL' WHEN 1 THEN 'uM' WHEN 2 THEN 'nM' WHEN 3 THEN 'μM' ELSE 'kg' END AS u, CASE WHEN l_linenumber % 3 = 0 THEN '-' WHEN l_linenumber % 3 = 1 THEN '–' END AS dash FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN u IN ('uM', 'μM') THEN q WHEN u = 'nM' THEN q / 1000 WHEN u = 'kg' THEN NULL ELSE q * 1000 / 2500 END, 6) AS um,
CASE WHEN dash IS NULL THEN q WHEN q <= 25 THEN q END AS lower, CASE WHEN dash IS NULL THEN q WHEN q <= 25 THEN 25.0 END AS upper FROM p
""")
def units_and_intervals(t):
    u = F.element_at(F.array(*map(F.lit, (" µg / mL", "uM", "nM", "μM", "kg"))), (F.col("l_linenumber") % 5 + 1).cast("int"))
    dash = F.when(F.col("l_linenumber") % 3 == 0, "-").when(F.col("l_linenumber") % 3 == 1, "–")
    q = F.col("l_quantity").cast("decimal(12,2)").cast("string")
    i = text.interval(F.coalesce(F.concat(q, F.lit(" "), dash, F.lit(" 25")), q))
    return t("lineitem").select("l_orderkey", "l_linenumber", r6(text.micromolar(F.col("l_quantity"), u, F.lit(2500.0))).alias("um"), i["lower"].alias("lower"), i["upper"].alias("upper"))


@query("""
SELECT p_partkey, array_to_string(string_split(p_name, ' ')[1:2], ' ') AS species, regexp_replace(p_brand || '-s' || p_size, '-s[0-9]+$', '') AS family, 'sha256_' || sha256(p_name) AS content_id,
CASE WHEN p_size <= 3 THEN [string_split(p_name, ' ')[p_size], string_split(p_name, ' ')[1]] ELSE [] END AS refs, (ascii(chr(65 + p_size % 26)) - 64 + 26 * (p_size % 3 + 1))::INT AS column_number FROM part WHERE len(string_split(p_name, ' ')) = 3
UNION ALL SELECT p_partkey, array_to_string(string_split(p_name, ' ')[1:2], ' '), regexp_replace(p_brand || '-s' || p_size, '-s[0-9]+$', ''), 'sha256_' || sha256(p_name), CASE WHEN p_size <= len(string_split(p_name, ' ')) THEN [string_split(p_name, ' ')[p_size], string_split(p_name, ' ')[1]] ELSE [] END, (ascii(chr(65 + p_size % 26)) - 64 + 26 * (p_size % 3 + 1))::INT FROM part WHERE len(string_split(p_name, ' ')) <> 3
""")
def names_and_keys(t):
    letters = F.concat(F.substring(F.lit("ABC"), (F.col("p_size") % 3 + 1).cast("int"), F.lit(1)), F.char(65 + F.col("p_size") % 26))
    refs = text.references(F.concat(F.col("p_size").cast("string"), F.lit(", 1")), F.split("p_name", " "))
    return t("part").select("p_partkey", text.species(F.col("p_name")).alias("species"), text.family(F.concat("p_brand", F.lit("-s"), "p_size")).alias("family"), text.content_id(F.col("p_name")).alias("content_id"), refs.alias("refs"), text.cell_column(letters).alias("column_number"))


@query("""
SELECT o_orderkey, [(o_orderstatus = 'F')::INT, (o_orderstatus = 'O')::INT, (o_orderstatus NOT IN ('F', 'O'))::INT] AS status, [(o_orderstatus = 'F')::INT * o_totalprice, (o_orderstatus = 'F')::INT * 2.0, (o_orderstatus = 'O')::INT * o_totalprice, (o_orderstatus = 'O')::INT * 2.0, (o_orderstatus NOT IN ('F', 'O'))::INT * o_totalprice, (o_orderstatus NOT IN ('F', 'O'))::INT * 2.0] AS crossed FROM orders
""")
def one_hot_and_interactions(t):
    hot = text.one_hot(F.col("o_orderstatus"), ["F", "O"])
    return t("orders").select("o_orderkey", hot.alias("status"), text.outer_product(hot, F.array("o_totalprice", F.lit(2.0))).alias("crossed"))


@query("""
WITH d AS (SELECT p_brand, upper(regexp_replace(translate(p_name, 'aeiousr', 'ACGTACG'), ' ', '', 'g')) AS s FROM part),
w AS (SELECT p_brand, s[i:i + 3] AS w FROM (SELECT p_brand, s, unnest(range(1, length(s) - 2)) AS i FROM d WHERE length(s) >= 4)),
v AS (SELECT p_brand, w FROM w WHERE regexp_full_match(w, '[ACGT]{4}')), b AS (SELECT p_brand, w FROM v UNION ALL SELECT p_brand, translate(reverse(w), 'ACGT', 'TGCA') FROM v)
SELECT p_brand, w AS word, round(count(*) / sum(count(*)) OVER (PARTITION BY p_brand), 9) AS share FROM b GROUP BY p_brand, w
""")
def four_letter_words(t):
    d = t("part").select("p_brand", F.explode(text.four_mers(F.regexp_replace(F.translate("p_name", "aeiousr", "ACGTACG"), " ", ""))).alias("w"))
    both = d.select("p_brand", F.explode(F.array("w", text.reverse_complement(F.col("w")))).alias("word")).groupBy("p_brand", "word").agg(F.count("*").alias("n"))
    total = both.groupBy("p_brand").agg(F.sum("n").alias("all"))
    return both.join(total, "p_brand").select("p_brand", "word", F.round(F.col("n") / F.col("all"), 9).alias("share"))


@query("""
SELECT 'events' AS scope, metric, stat, round(value, 4) AS value FROM (SELECT count(value)::DOUBLE AS value_n, avg(value) AS value_mean, min(value) AS value_min, max(value) AS value_max FROM events)
UNPIVOT (value FOR name IN (value_n, value_mean, value_min, value_max)), LATERAL (SELECT split_part(name, '_', 1) AS metric, split_part(name, '_', 2) AS stat)
""")
def summary_rows(t):
    wide = t("events").agg(F.count("value").cast("double").alias("value_n"), F.avg("value").alias("value_mean"), F.min("value").alias("value_min"), F.max("value").alias("value_max"))
    long = wide.unpivot([], wide.columns, "name", "value")
    return long.select(F.lit("events").alias("scope"), F.split_part("name", F.lit("_"), F.lit(1)).alias("metric"), F.split_part("name", F.lit("_"), F.lit(2)).alias("stat"), F.round("value", 4).alias("value"))


@query("""
SELECT p_partkey, list_max(list_transform(range(1, greatest(length(s) - 8 + 1, 1) + 1), lambda i: length(regexp_replace(s[i:i + least(length(s), 8) - 1], '[^AILMFWVC]', '', 'g')) / least(length(s), 8)::DOUBLE)) AS best_window, pow(10.0, 6 - p_partkey % 9) AS um
FROM (SELECT p_partkey, regexp_replace(upper(p_name), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS s FROM part) WHERE s <> ''
""")
def sliding_windows(t):
    own = {c: 1.0 for c in "AILMFWVC"}
    return parts(t).where("s <> ''").select("p_partkey", seq.window_mean_max(F.col("s"), own, 8).alias("best_window"), physchem.to_value((F.col("p_partkey") % 9).cast("double")).alias("um"))


@query("""
SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS missing, CASE WHEN count(*) FILTER (l_returnflag = 'R') = 0 THEN round(sum(l_tax), 6) END AS total FROM lineitem GROUP BY l_orderkey
""")
def nulled_metrics(t):
    l = t("lineitem").withColumn("m", F.when(F.col("l_returnflag") != "R", F.col("l_tax")))
    return measure.null_if_any_missing(l, "m", ["l_orderkey"]).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("missing"), r6(F.sum("m")).alias("total"))
