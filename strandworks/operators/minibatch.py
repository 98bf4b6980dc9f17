"""k-means by mini-batches: several starts fitted side by side on hash-drawn batches, the one of least inertia over all rows kept.

A fit reads the table twice: once to draw its batches (``steps * batch`` rows, which is what it learns from) and
once for the inertia of every start; keys are unique, since rows are drawn by them. Each step goes over one batch for all starts; a centre moves to the mean of
all rows that it was given so far. Vectors that are null, of another length than the first drawn one, or hold null
or non-finite values take no part and get no cluster. Ties go to the lower centre; equal tables give equal fits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .graph import cut

#: Numbers of a table of distances in a task.
CELLS = 4_000_000


@dataclass(frozen=True)
class Clusters:
    centres: np.ndarray  # k, d
    inertia: list[float]  # of each start, over all rows
    start: int


def _sound(x: Column) -> Column:
    return F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & ~v.isin(float("inf"), float("-inf"))), F.lit(False))


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centre, squared distance) of each row, in slices of bounded size."""
    at, far = np.zeros(len(x), np.int64), np.zeros(len(x))
    rows = max(1, CELLS // max(1, len(centres)))
    half = (centres * centres).sum(axis=1) / 2
    for lo in range(0, len(x), rows):
        own = x[lo : lo + rows]
        at[lo : lo + rows] = (half - own @ centres.T).argmin(axis=1)
        far[lo : lo + rows] = ((own - centres[at[lo : lo + rows]]) ** 2).sum(axis=1)
    return at, far


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def fit(df: DataFrame, key: str, vector: str, k: int, seed: int = 42, starts: int = 10, steps: int = 50, batch: int = 4096) -> Clusters:
    """Centres of the best of ``starts`` starts; each begins with k drawn rows of its own."""
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("key"), F.transform(F.col(vector), lambda v: v.cast("double")).alias("x")).where(_sound(F.col("x")))
    share = min(1.0, steps * batch / max(1, rows.count()))
    part = lambda *of: F.pmod(F.xxhash64(F.lit(seed), *of, "key"), F.lit(1 << 40))
    drawn = rows.where(part(F.lit("drawn")) <= int(share * (1 << 40))).withColumn("step", F.pmod(part(F.lit("step")), F.lit(steps)))
    drawn = cut(drawn.repartition("step").sortWithinPartitions("step", "key", "x"))
    first = drawn.orderBy("key", "x").limit(1).collect()
    width = len(first[0].x) if first else 0
    drawn = drawn.where(F.size("x") == width)
    centres = []
    for s in range(starts):
        own = drawn.orderBy(part(F.lit(f"start {s}")), "key", "x").limit(k).select("x").collect()
        if len(own) < k:
            raise ValueError(f"{len(own)} usable vectors for {k} clusters")
        centres.append([r.x for r in own])
    centres = np.array(centres)
    seen = np.zeros((starts, k))

    for step in range(steps):
        shared = spark.sparkContext.broadcast(centres)  # starts * k * d numbers, parameters

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros_like(shared.value), np.zeros(shared.value.shape[:2])
            for b in batches:
                x = _matrix(b.column(0), width)
                for s, own in enumerate(shared.value):
                    at, _ = nearest(x, own)
                    np.add.at(total[s], at, x)
                    count[s] += np.bincount(at, minlength=k)
            hit = np.argwhere(count)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(hit[:, 0], pa.int32()), pa.array(hit[:, 1], pa.int32()), pa.array(count[tuple(hit.T)]), pa.array(total[tuple(hit.T)].tolist(), pa.list_(pa.float64()))], names=["start", "centre", "n", "x"])

        got = drawn.where(F.col("step") == step).select("x").mapInArrow(sums, "start int, centre int, n double, x array<double>")
        total, count = np.zeros_like(centres), np.zeros((starts, k))
        for r in got.collect():  # a step's rows lie in one partition: at most min(k, batch) centres a start
            total[r.start, r.centre] += r.x
            count[r.start, r.centre] += r.n
        seen += count
        centres = centres + np.where(seen[..., None] > 0, (total - count[..., None] * centres) / np.maximum(seen, 1)[..., None], 0)
        shared.unpersist()

    last = spark.sparkContext.broadcast(centres)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(starts)
        for b in batches:
            x = _matrix(b.column(0), width)
            out += [nearest(x, own)[1].sum() for own in last.value]
        yield pa.RecordBatch.from_arrays([pa.array(range(starts), pa.int32()), pa.array(out)], names=["start", "inertia"])

    inertia = rows.where(F.size("x") == width).select("x").mapInArrow(spread, "start int, inertia double").groupBy("start").agg(F.sum("inertia").alias("i"))
    inertia = [v for _, v in sorted((r.start, r.i) for r in inertia.collect())]
    best = int(np.argmin(inertia))
    return Clusters(centres[best], inertia, best)


def predict(df: DataFrame, vector: str, clusters: Clusters, out: str = "cluster") -> DataFrame:
    """Add the nearest centre's number; null for a vector that takes no part."""
    width = clusters.centres.shape[1]
    shared = df.sparkSession.sparkContext.broadcast(clusters.centres)

    @F.pandas_udf("int")
    def place(xs: pd.Series) -> pd.Series:
        known = xs.notna().to_numpy()
        got = pd.Series([None] * len(xs), dtype="Int32")
        if known.any():
            got[known] = nearest(np.stack(xs[known].to_numpy()).astype(np.float64), shared.value)[0]
        return got

    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    return df.withColumn(out, place(F.when(_sound(x) & (F.size(x) == width), x)))
