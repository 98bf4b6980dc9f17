"""op9: personal data in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import pii
from .common import table


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")
