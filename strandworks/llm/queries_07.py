"""op7: near-duplicates among all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import rp_forest
from .common import table


def op7_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rp_forest.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE_7 = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[64] AS e FROM embeddings WHERE embedding IS NOT NULL
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND array_cosine_similarity(a.e, b.e) >= 0.9
), n AS (
  SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a
), c AS (
  WITH RECURSIVE r(vec_id, seen) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.seen = l.a)
  SELECT vec_id, min(seen) AS component_id FROM r GROUP BY vec_id
)
SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, e.vec_id) AS component_id, e.vec_id = coalesce(component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""
