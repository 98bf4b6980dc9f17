"""op1: quality rules with cross-document line frequency over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import line_quality as L
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.judge(table(spark, sf_dir, "documents")).drop("cleaned")


ORACLE_1 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents
), s AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, string_split(text, chr(10)) AS lines FROM d
), w AS (
  SELECT r, i, array_to_string(words[i:i + 7], ' ') AS span FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM s WHERE len(words) >= 8)
), twice AS (
  SELECT r, unnest(range(i, i + 8)) AS j FROM (SELECT r, i, count(*) OVER (PARTITION BY r, span) AS n FROM w) WHERE n > 1
), rep AS (
  SELECT r, count(DISTINCT j) AS n FROM twice GROUP BY r
), l AS (
  SELECT r, doc_id, host, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm
  FROM (SELECT r, doc_id, host, unnest(lines) AS line FROM s)
), c AS (
  SELECT host, norm, count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) AS docs, min(doc_id) AS first_id FROM l WHERE n > 0 GROUP BY host, norm
), common AS (
  SELECT * FROM c WHERE docs > {L.MIN_DOCS}
), gone AS (
  SELECT l.r, count(*) AS lines, sum(l.n) AS gone_words FROM l JOIN common c ON l.host IS NOT DISTINCT FROM c.host AND l.norm = c.norm
  WHERE l.n > 0 AND l.doc_id IS DISTINCT FROM c.first_id GROUP BY l.r
), dup AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM l WHERE n > 0 GROUP BY r
), b AS (
  SELECT s.r, doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    coalesce(gone.lines, 0)::BIGINT AS n_removed_lines, (len(words) - coalesce(gone.gone_words, 0))::BIGINT AS n_words_left
  FROM s LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r)
), f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words_left >= {L.MIN_WORDS} AND n_words_left >= {L.MIN_LEFT}::DOUBLE * n_words AS kept, n_removed_lines, n_words_left
FROM f
"""
