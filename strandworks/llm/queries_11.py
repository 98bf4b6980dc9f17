"""op11: divergence of all (lang, source) groups of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import divergence as D
from .common import table


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.measured(table(spark, sf_dir, "documents"))


_P = f"1 + ({D.UNIT}::HUGEINT * ({{}} + {D.PRIOR})) // ({{}} + {D.PRIOR} * v)"
ORACLE_11 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), w AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {D.MIN_DOCS}
), l AS (
  SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL
), h AS (
  SELECT lang, source, sum(c.n) AS held FROM c JOIN k USING (lang, term) GROUP BY ALL
), p AS (
  SELECT lang, source, term, coalesce(c.n, 0) AS n, {_P.format("coalesce(c.n, 0)", "coalesce(held, 0)")} AS p, {_P.format("total", "l.n")} AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN h USING (lang, source) LEFT JOIN c USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL
), best AS (
  SELECT lang, source, term AS item, p - q AS value, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS rank FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value::BIGINT, rank::INT FROM best WHERE rank <= {D.TOP}
"""
