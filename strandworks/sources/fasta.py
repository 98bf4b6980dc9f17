"""FASTA reading and writing through Spark's own file layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..operators.graph import cut
from ..operators.joins import ContractError


def read_fasta(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(file, idx, header, sequence): sequences joined over lines and upper-cased; idx is the record's number in its file, from 0.

    Records are cut at ``\\n>`` by the text reader, so files are split over tasks; a record's number is its
    place in its split plus the records of the splits before. Strict: text before the first header, an empty
    header or sequence, and files without records are errors; else such are left out.
    """
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), "value", F.monotonically_increasing_id().alias("_id"))
    opens = (F.col("_block") == 0) & F.col("value").startswith(">")
    text = F.regexp_replace(F.when(opens, F.substring("value", 2, 2_000_000_000)).otherwise(F.col("value")), "\r", "")
    head = F.substring_index(text, "\n", 1)
    body = F.upper(F.regexp_replace(F.substring(text, F.length(head) + 1, F.lit(2_000_000_000)), r"\s+", ""))
    rows = rows.select("file", "_block", "_id", F.trim(head).alias("header"), body.alias("sequence"), (opens | F.col("_block").isNull()).alias("_opens"))
    rows = cut(rows)
    splits = rows.groupBy("file", "_block").agg(F.min("_id").alias("_low"), F.count("*").alias("_n"), F.min_by("_opens", "_id").alias("_first"))  # a row a split
    splits = splits.withColumn("_base", F.sum("_n").over(W.partitionBy("file").orderBy("_block").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n"))
    splits = splits.select(F.col("file").alias("_f"), F.col("_block").alias("_b"), "_low", "_base", "_first")
    rows = rows.join(splits, (F.col("file") == F.col("_f")) & (F.col("_block") == F.col("_b")))
    loose = (F.col("_block") == 0) & (F.col("_id") == F.col("_low")) & ~F.col("_first")
    rows = rows.select("file", (F.col("_id") - F.col("_low") + F.col("_base")).alias("idx"), "header", "sequence", loose.alias("_loose"))
    if strict:
        bad = rows.where("_loose OR header = '' OR sequence = ''").take(1)
        if bad or rows.isEmpty():
            raise ContractError(f"not a FASTA file: {bad[0].file if bad else path}")
    kept = rows.where("NOT _loose AND header <> '' AND sequence <> ''").drop("_loose")
    return kept


def headers_and_sequences(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(file, idx, header) and (file, idx, sequence) of a file that must be well formed."""
    rows = read_fasta(spark, path)
    return rows.select("file", "idx", "header"), rows.select("file", "idx", "sequence")


def write_fasta(df: DataFrame, path: str, order: str = "idx") -> None:
    """Ordered FASTA files under path; an empty table, header or sequence is an error."""
    bad = df.where("coalesce(header, '') = '' OR coalesce(sequence, '') = ''").take(1)
    if bad or df.isEmpty():
        raise ContractError("nothing to write, or a record without header or sequence")
    df.orderBy(order).select(F.concat(F.lit(">"), F.col("header"), F.lit("\n"), F.col("sequence")).alias("value")).write.text(path)


def write_one_fasta(df: DataFrame, path: str, order: str = "idx") -> None:
    """One FASTA file, in order; rows pass the driver one partition at a time."""
    bad = df.where("coalesce(header, '') = '' OR coalesce(sequence, '') = ''").take(1)
    if bad or df.isEmpty():
        raise ContractError("nothing to write, or a record without header or sequence")
    with open(path, "w", encoding="utf-8") as f:
        for r in df.orderBy(order).select("header", "sequence").toLocalIterator():
            f.write(f">{r.header}\n{r.sequence}\n")


def candidates_to_fasta(df: DataFrame, path: str, key: str, text: str, valid: str, order: str) -> None:
    """The valid rows as one FASTA file, headed by their key."""
    write_one_fasta(df.where(F.col(valid)).select(F.col(order).alias("idx"), F.col(key).cast("string").alias("header"), F.col(text).alias("sequence")), path)
