"""Ridge heads over folds: all second moments in one pass, training sets by subtraction, outer folds scored once.

Moments (n, sums, products) are gathered for each (fold, head) in tasks and summed by Spark; the moments of a
training set are those of all rows less those of the folds it leaves out. Standardisation, by the training
set's own means and deviations, and the fit come from these moments alone, so no fit scans rows again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .metrics import nested_choice


def fold_moments(df: DataFrame, features: list[str], target: str, fold: str, head: str) -> dict[int, dict[str, np.ndarray]]:
    """For each fold and head the products of (features, 1, target), over rows where none is null; (d + 2)^2 numbers each on the driver."""
    d = len(features) + 2
    x = F.array(*[F.col(c).cast("double") for c in features], F.lit(1.0), F.col(target).cast("double"))
    rows = df.dropna(subset=[*features, target, fold, head]).select(F.col(fold).cast("int").alias("fold"), F.col(head).cast("string").alias("head"), x.alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            m = batch.column("x").flatten().to_numpy().reshape(-1, d)
            names: dict[tuple, int] = {}
            at = np.array([names.setdefault(k, len(names)) for k in zip(batch.column("fold").to_pylist(), batch.column("head").to_pylist())])
            for key, k in names.items():
                own = m[at == k]
                sums[key] = sums.get(key, 0) + own.T @ own
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.string()), pa.array([v.reshape(-1).tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["fold", "head", "m"])

    got = rows.mapInArrow(run, "fold int, head string, m array<double>").select("fold", "head", F.posexplode("m").alias("i", "v")).groupBy("fold", "head", "i").agg(F.sum("v").alias("v"))
    out: dict[int, dict[str, np.ndarray]] = {}
    for r in got.collect():
        out.setdefault(r["fold"], {}).setdefault(r["head"], np.zeros(d * d))[r["i"]] = r["v"]
    return {f: {h: m.reshape(d, d) for h, m in own.items()} for f, own in out.items()}


def without(moments: dict[int, dict[str, np.ndarray]], folds: set[int]) -> dict[str, np.ndarray]:
    """The moments of each head over all folds but those."""
    out: dict[str, np.ndarray] = {}
    for f, own in moments.items():
        if f not in folds:
            for h, m in own.items():
                out[h] = out.get(h, 0) + m
    return out


def solve(m: np.ndarray, penalty: float) -> list[float]:
    """Weights on the features as they are, then the intercept: a ridge fit of standardised features, the intercept free."""
    n, s, sy = m[-2, -2], m[:-2, -2], m[-1, -2]
    mean, y = s / n, sy / n
    centred = m[:-2, :-2] - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(centred) / n, 0))
    scale[scale <= 1e-12 * np.maximum(1, np.abs(mean))] = 1.0
    z, zy = centred / np.outer(scale, scale), (m[:-2, -1] - n * mean * y) / scale
    w = np.linalg.lstsq(z + penalty * np.eye(len(z)), zy, rcond=None)[0] / scale
    return [*w.tolist(), float(y - w @ mean)]


def models(df: DataFrame, moments: dict[int, dict[str, np.ndarray]], penalties: list[float]) -> DataFrame:
    """(outer, inner, head, penalty, w): the fit without the folds outer and inner; inner = outer is the outer fold's own model."""
    rows = []
    for o in sorted(moments):
        for i in sorted(moments):
            for h, m in without(moments, {o, i}).items():
                rows += [(o, i, h, float(p), solve(m, p)) for p in penalties]
    return df.sparkSession.createDataFrame(rows, "outer int, inner int, head string, penalty double, w array<double>")


def nested_ridge(df: DataFrame, key: str, features: list[str], target: str, fold: str, head: str, penalties: list[float]) -> tuple[DataFrame, DataFrame]:
    """Nested selection of the penalty -> (outer, penalty, macro_mae) and the out-of-fold predictions (key, head, fold, penalty, predicted).

    For each outer fold, each other fold is scored by fits without both; the penalty of the least mean of
    macro errors (over heads), ties to the smaller, is fitted without the outer fold, which it scores once.
    Two scans besides the moments': one of all inner scores, one of the outer ones.
    """
    moments = fold_moments(df, features, target, fold, head)
    if len(moments) < 3:
        raise ValueError("nested selection needs three folds")
    table = models(df, moments, penalties)  # folds^2 x heads x penalties rows
    x = F.array(*[F.col(c).cast("double") for c in features], F.lit(1.0))
    rows = df.dropna(subset=[*features, target, fold, head]).select(key, F.col(fold).cast("int").alias("fold"), F.col(head).cast("string").alias("head"), F.col(target).cast("double").alias("y"), x.alias("x"))
    value = F.aggregate(F.zip_with("x", "w", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    inner = rows.join(F.broadcast(table.where("outer <> inner").withColumnRenamed("inner", "fold")), ["fold", "head"])
    scored = inner.withColumn("e", F.abs(F.col("y") - value)).groupBy("outer", "penalty", F.col("fold").alias("inner"), "head").agg(F.avg("e").alias("mae"))
    macro = scored.groupBy("outer", "penalty", "inner").agg(F.avg("mae").alias("macro_mae"))
    chosen = nested_choice(macro, "outer", "penalty", [("macro_mae", True)])
    final = table.where("outer = inner").join(chosen, ["outer", "penalty"]).select(F.col("outer").alias("fold"), "head", "penalty", "w")
    done = rows.join(F.broadcast(final), ["fold", "head"]).select(key, "head", "fold", "penalty", value.alias("predicted"), "y")
    report = done.groupBy("fold", "penalty", "head").agg(F.avg(F.abs(F.col("y") - F.col("predicted"))).alias("mae")).groupBy(F.col("fold").alias("outer"), "penalty").agg(F.avg("mae").alias("macro_mae"))
    return report, done.drop("y")
