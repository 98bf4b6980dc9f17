"""op4: SimHash near-duplicates over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import simhash
from .common import table


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
