"""op5: WARC archives of all pages, written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import warc
from .common import cut, remove, table


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.new_path(spark)
    warc.write(table(spark, sf_dir, "pages"), path)
    found = cut(warc.digests(spark, path), "pages")
    remove(spark, path)
    return found


ORACLE_5 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS n FROM pages
), f AS (
  SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY html) END AS first_id FROM p
)
SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""
