"""Shards of near-equal bytes for groups that can't be divided, by Karmarkar-Karp differencing.

Rows of one group (here: equal texts) go to one shard. The differencing starts with a partial partition for
each item, whose ``shards`` parts are empty but for one, and combines the two of the largest spread (largest
part less smallest) again and again, the largest part of one with the smallest of the other, until one
partition is left.

Items are the groups of at least 1 / (``FINE`` x shards) of all bytes, at most ``FINE`` x shards of them,
one by one; all others are dealt by a hash of the group to ``BUNDLES`` bundles, each an item. So the number
of items has a bound that doesn't depend on the table, and so have the differencing on the driver and the
plan that is broadcast: groups are counted by Spark and never leave it. Bundles differ in size by chance,
and the differencing evens that out to some bytes.

Places in a shard are counted up within each task, and the tasks' counts are summed up before them; no task
holds a shard.

Rows: a null text is an empty one (size: 8 bytes); repeated rows and null ids stay rows of their own;
texts that share a 64-bit hash are one group; no rows give no rows; other columns aren't used.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import carried, cut, drop_cut

SHARDS, FINE, BUNDLES, OVERHEAD = 24, 512, 32_768, 8


def differences(sizes: list[int], parts: int) -> list[int]:
    """The part of each item, by differencing; equal spreads: the earlier made partition first."""
    if not sizes or parts < 2:
        return [0] * len(sizes)
    # a partition: its parts as (sum, tree), largest first; a tree: an item or a pair of trees
    heap = [(-s, k, [(s, k), *[(0, None)] * (parts - 1)]) for k, s in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        both = [(x + y, s if t is None else t if s is None else (s, t)) for (x, s), (y, t) in zip(a, reversed(b))]
        both.sort(key=lambda p: -p[0])
        low = both[-1][0]
        both = [(s - low, t) for s, t in both]
        heapq.heappush(heap, (-both[0][0], made, both))
        made += 1
    out = [0] * len(sizes)
    for part, (_, tree) in enumerate(heap[0][2]):
        left = [] if tree is None else [tree]
        while left:
            t = left.pop()
            if isinstance(t, tuple):
                left += t
            else:
                out[t] = part
    return out


def plan(groups: DataFrame, shards: int = SHARDS, fine: int = FINE, bundles: int = BUNDLES) -> DataFrame:
    """(key, bytes), a row for each group -> (item, single, shard): ``item`` is the key of a group that stands alone, else a bundle."""
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    alone = F.col("bytes").cast("decimal(38,0)") * (fine * shards) >= F.lit(total).cast("decimal(38,0)")
    items = groups.select(F.when(alone, F.col("key")).otherwise(F.pmod("key", F.lit(bundles))).alias("item"), alone.alias("single"), "bytes")
    found = items.groupBy("single", "item").agg(F.sum("bytes").alias("bytes")).toArrow().sort_by([("bytes", "descending"), ("single", "ascending"), ("item", "ascending")])
    part = differences(found.column("bytes").to_pylist(), shards)
    table = pa.table({"item": found.column("item"), "single": found.column("single"), "shard": pa.array(part, pa.int32())})
    return groups.sparkSession.createDataFrame(table)


def placed(rows: DataFrame) -> DataFrame:
    """Rows with a shard -> with ``slot``, the place in the shard, gapless from 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            order = np.argsort(shard, kind="stable")
            kinds, starts, sizes = np.unique(shard[order], return_index=True, return_counts=True)
            before = np.array([seen.get(int(k), 0) for k in kinds], np.int64)
            at = np.empty(len(shard), np.int64)
            at[order] = np.arange(len(shard)) - np.repeat(starts, sizes) + np.repeat(before, sizes)
            seen |= {int(k): int(b + s) for k, b, s in zip(kinds, before, sizes)}
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=[*batch.schema.names, "at"])

    kinds = T.StructType([*rows.schema.fields, T.StructField("at", T.LongType())])
    done = cut(rows.mapInArrow(count, kinds).withColumn("task", F.spark_partition_id()), "shards")
    ends = done.groupBy("task", "shard").agg((F.max("at") + 1).alias("n"))
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("task", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return done.join(starts, ["task", "shard"]).withColumn("slot", F.col("start") + F.col("at")).drop("task", "at", "start")


def shard(docs: DataFrame, shards: int = SHARDS, fine: int = FINE, bundles: int = BUNDLES, carry: list[str] | None = None) -> DataFrame:
    """docs -> doc_id, size, text_crc32, shard, slot, and ``row`` of carried columns."""
    more, _ = carried(docs, carry)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"), *more)
    groups = cut(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    found = plan(groups, shards, fine, bundles)
    # at most fine * shards + bundles rows
    alone = F.broadcast(found.where("single").select(F.col("item").alias("key"), F.col("shard").alias("own")))
    dealt = F.broadcast(found.where("NOT single").select("item", F.col("shard").alias("dealt")))
    rows = rows.join(alone, "key", "left").join(dealt, F.pmod("key", F.lit(bundles)) == F.col("item"), "left")
    out = placed(rows.select("doc_id", "size", "text_crc32", F.coalesce("own", "dealt").alias("shard"), *(["row"] if more else [])))
    drop_cut(groups)
    return out.select("doc_id", "size", "text_crc32", "shard", "slot", *(["row"] if more else []))


def write(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write the documents, all columns and the place, into a folder ``shard=k`` for each shard."""
    rows = shard(docs, shards, carry=docs.columns)
    rows.select("row.*", F.col("slot").alias("_slot"), "shard").write.partitionBy("shard").parquet(path)
