"""op8: toxicity of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import toxicity as X
from .common import table


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = X.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return X.score(docs, net).select("doc_id", X.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= X.THRESHOLD).cast("int").alias("predicted"))
