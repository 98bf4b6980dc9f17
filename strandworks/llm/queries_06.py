"""op6: packing of all documents into sequences of 4096 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import packing
from .common import table


def op6_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return packing.pack(table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"))
