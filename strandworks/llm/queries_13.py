"""op13: all documents in 24 shards of near-equal bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import sharding
from .common import table


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"))
    return found.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))
