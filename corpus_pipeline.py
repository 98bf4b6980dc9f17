"""The corpus pipeline: quality rules, toxicity, near-duplicates, personal data, packing.

Each stage works on all that the one before it kept. Columns of a table other than those of documents
aren't carried along. Stages 1 and 4 change texts (boilerplate lines go, personal data is replaced by its
kind) and count n_chars anew. Near-duplicates go by exact Jaccard similarity of five-word shingles.

Rows: null and empty texts fail the quality rules; a null id is never held out, never a copy of others and
stays a row of its own; repeated rows are judged alike, and of those with one id and text one stays; of
near copies the smallest id stays; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandworks.llm import line_quality, near_copies, packing, pii, toxicity
from strandworks.llm.common import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
REST = ["lang", "source", "n_chars"]


def _renewed(found: DataFrame) -> DataFrame:
    """Rows with a new text in ``cleaned`` and their other columns in ``row``."""
    return found.select("doc_id", F.col("cleaned").alias("text"), "row.lang", "row.source", F.length("cleaned").cast("long").alias("n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _renewed(line_quality.judge(docs, carry=REST).where("kept"))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = toxicity.score(docs, toxicity.fit(docs, labels), carry=["text", *REST])
    return scored.where(F.col("score") < toxicity.THRESHOLD).select("doc_id", "row.text", "row.lang", "row.source", "row.n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.representatives(docs.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _renewed(pii.find(docs, clean=True, carry=REST))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("toxicity", toxic), ("near-duplicates", near_duplicates), ("personal data", personal_data), ("packing", packed)]
#: The network, the field and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name.replace(" ", "-"))
    return docs
