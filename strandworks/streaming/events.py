"""Event streams (an extension): windows with watermarks over tables of timed events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def tumbling(df: DataFrame, ts: str, key: str, value: str, width: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """Count and sum a window and key; late rows are dropped by watermark on streams."""
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    if df.isStreaming and late:
        df = df.withWatermark(ts, late)
    out = df.groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), key, "n", "total")


def sessions(df: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str | None = "10 minutes") -> DataFrame:
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    if df.isStreaming and late:
        df = df.withWatermark(ts, late)
    out = df.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), key, "n")


def distinct_events(df: DataFrame, ts: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    if df.isStreaming:
        return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
    return df.dropDuplicates(keys)
