"""op2: byte-level BPE over all documents, there and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe
from .common import table


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    docs = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, P.PATTERN)
    docs = bpe.decode(docs.select("doc_id", "ids"), path)
    return docs.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
