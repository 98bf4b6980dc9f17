"""Shared pieces of the training-data operators: durable cuts, components, table reading."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    The cluster names it in spark.checkpoint.dir. Only where that is unset and all runs on one machine is a
    local folder made and set; on a cluster an unset folder is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="strandworks-")
        spark.sparkContext.setCheckpointDir(path)
    return path


_runs: dict[str, SparkSession] = {}


def run_dir(spark: SparkSession) -> str:
    """This application's folder below the shared one: it holds every cut and goes when the program ends."""
    path = f"{shared_dir(spark)}/strandworks/{spark.sparkContext.applicationId}-{os.getpid()}"
    if path not in _runs:
        if not _runs:
            atexit.register(clear)
        _runs[path] = spark
    return path


def clear() -> None:
    """Delete what the cuts of this program left; nothing that reads them may be in use."""
    for path, spark in list(_runs.items()):
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  Spark has stopped: the folder stays for the cluster's own clean-up
            pass
        _runs.pop(path, None)


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage ends there, whatever executors are lost."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandworks_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind a frame that cut() made, once nothing reads it."""
    path = getattr(df, "_strandworks_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _digest(edges: DataFrame) -> tuple:
    """Tells edge sets apart without comparing rows."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit(2_147_483_647)))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: (src, dst) longs in, (node, root) out, root = the smallest node reachable.

    Alternating large-star and small-star rounds over the edge list until it no longer changes. Each
    round's edges are written to the shared folder. Each star keys on a node, so a node of many edges
    would be a hot key: callers give spanning edges (each group of n nodes has about n edges), and the
    min of a star is aggregated before the shuffle and joined back, which Spark may split on skew.
    An empty edge list gives no rows; loops and repeated or null-ended edges count for nothing.
    """
    cur = cut(
        edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct(),
        "cc",
    )
    now = _digest(cur)
    for _ in range(max_rounds):
        both = cur.union(cur.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node below all its neighbours keeps them: they are its rows (neighbour, node) in `large`
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select(F.col("e.a").alias("u"), F.col("e.b").alias("v"))
            .where("u <> v")
            .distinct()
        )
        new = cut(small, "cc")
        drop_cut(cur)
        cur, before, now = new, now, _digest(new)
        if now == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def blocks(batch: pa.RecordBatch, size: int = 500_000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose values have about so many bytes, so that what is made of one slice fits in memory.

    A value above the size is a slice of its own.
    """
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and held + n > size:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if batch.num_rows > start:
        yield batch.slice(start)


def carried(df: DataFrame, names: list[str] | None) -> tuple[list, str]:
    """A struct column ``row`` of the named columns, to go through a Python stage untouched, and its part of a schema."""
    if not names:
        return [], ""
    kinds = ", ".join(f"`{n}`: {df.schema[n].dataType.simpleString()}" for n in names)
    return [F.struct(*names).alias("row")], f", row struct<{kinds}>"
