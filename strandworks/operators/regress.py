"""Regressors of censored values: fitted by full gradients that Spark sums, over bounds instead of points.

A row has a lower and an upper bound; a null bound is open, equal bounds are an exact value. Each step's
gradient is summed in columns, or over Arrow blocks in tasks where it takes the normal distribution function.
What reaches the driver is one number for each weight. Rows of a group weigh one together, however many they are.

Two losses: the squared distance to the interval (``hinge``), with one linear head; and the negative log
probability of the interval under a normal distribution (``normal``), with a linear mean and a scale of
softplus form for each head. Steps are Adam's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .graph import cut
from .rank import quantiles

RATE, BETA_1, BETA_2, TINY = 0.02, 0.9, 0.999, 1e-8  # fixed values: the usual settings of Adam


@dataclass
class Fit:
    """A fitted head: standardised features x give intercept + coefficients . x."""

    features: list[str]
    mean: list[float]
    scale: list[float]
    coefficients: dict[str, list[float]]
    intercept: dict[str, float]
    spread: dict[str, list[float]] = field(default_factory=dict)  # of the scale: weights, then intercept
    floor: float = 0.0
    losses: list[float] = field(default_factory=list)

    def standard(self) -> list[Column]:
        return [(F.col(c).cast("double") - m) / s for c, m, s in zip(self.features, self.mean, self.scale)]

    def value(self, head: str = "") -> Column:
        """The predicted value (the mean) of a row."""
        return sum((z * w for z, w in zip(self.standard(), self.coefficients[head])), F.lit(self.intercept[head]))

    def deviation(self, head: str = "") -> Column:
        """The predicted scale of a row."""
        z = sum((x * w for x, w in zip(self.standard(), self.spread[head][:-1])), F.lit(self.spread[head][-1]))
        return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) + self.floor


def median(df: DataFrame, column: str) -> float | None:
    """The exact median, from the counts of distinct values dealt by ranges."""
    got = quantiles(df, [column], (0.5,))[column].first()
    return got["q"][0] if got and got["q"][0] is not None else None


def log_cdf(z: np.ndarray) -> np.ndarray:
    """log of the normal distribution function, without underflow."""
    out = np.empty_like(z)
    near = z > -20
    out[near] = np.log(0.5 * np.array([math.erfc(-x / math.sqrt(2)) for x in z[near].tolist()]))
    f = z[~near]
    s = 1 / (f * f)
    out[~near] = -0.5 * f * f - 0.5 * math.log(2 * math.pi) - np.log(-f) + np.log1p(-s * (1 - 3 * s * (1 - 5 * s * (1 - 7 * s))))
    return out


def log_density(z: np.ndarray) -> np.ndarray:
    return -0.5 * z * z - 0.5 * math.log(2 * math.pi)


def normal_loss(mean: np.ndarray, scale: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Negative log probability of [low, high] (density if equal), and its derivatives by mean and scale."""
    loss, by_mean, by_scale = (np.zeros(len(mean)) for _ in range(3))
    exact, left, right = low == high, np.isneginf(low), np.isposinf(high)
    z = (low[exact] - mean[exact]) / scale[exact]
    loss[exact], by_mean[exact], by_scale[exact] = np.log(scale[exact]) - log_density(z), -z / scale[exact], (1 - z * z) / scale[exact]
    for rows, sign, bound in ((left & ~exact, 1.0, high), (right & ~exact, -1.0, low)):
        z = sign * (bound[rows] - mean[rows]) / scale[rows]
        p = log_cdf(z)
        hazard = np.exp(log_density(z) - p)
        loss[rows], by_mean[rows], by_scale[rows] = -p, sign * hazard / scale[rows], hazard * z / scale[rows]
    both = ~(exact | left | right)
    a, b = ((x[both] - mean[both]) / scale[both] for x in (low, high))
    flip = a > 0  # in the upper tail, by survival
    hi, lo = log_cdf(np.where(flip, -a, b)), log_cdf(np.where(flip, -b, a))
    p = hi + np.log(-np.expm1(np.minimum(lo - hi, -1e-300)))
    pa_, pb = np.exp(log_density(a) - p), np.exp(log_density(b) - p)
    loss[both], by_mean[both], by_scale[both] = -p, (pb - pa_) / scale[both], (b * pb - a * pa_) / scale[both]
    return loss, by_mean, by_scale


def hinge_loss(value: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance to [low, high], and its derivative."""
    under, over = np.maximum(low - value, 0), np.maximum(value - high, 0)
    return under**2 + over**2, 2 * (over - under)


def _prepared(df: DataFrame, features: list[str], lower: str, upper: str, group: str | None, head: str | None) -> tuple[DataFrame, list[float], list[float], list[str]]:
    """(head by number, x0.., low, high, weight), standardised and checked; the means and scales; the heads."""
    bad = lambda c: F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    checks = {
        "features that are null or not finite": sum(((F.col(c).isNull() | F.coalesce(bad(c), F.lit(False))).cast("int") for c in features), F.lit(0)) > 0,
        "bounds that are not finite; leave absent ones null": F.coalesce(bad(lower), F.lit(False)) | F.coalesce(bad(upper), F.lit(False)),
        "rows without a bound": F.col(lower).isNull() & F.col(upper).isNull(),
        "inverted bounds": F.coalesce(F.col(lower) > F.col(upper), F.lit(False)),
    }
    stats = [x for c in features for x in (F.avg(F.col(c).cast("double")), F.stddev_pop(F.col(c).cast("double")))]
    got = df.agg(F.count("*"), *[count(c) for c in checks.values()], *stats).first()
    if not got[0]:
        raise ValueError("no rows to fit")
    for k, name in enumerate(checks):
        if got[1 + k]:
            raise ValueError(f"{got[1 + k]} {name}")
    values = got[1 + len(checks) :]
    mean, scale = list(values[0::2]), [s or 1.0 for s in values[1::2]]
    x = [((F.col(c).cast("double") - m) / s).alias(f"x{i}") for i, (c, m, s) in enumerate(zip(features, mean, scale))]
    names = [f"x{i}" for i in range(len(features))]
    # a head has weights of its own: few. Rows carry its number, so that no step handles strings or lists
    heads = [r[0] for r in df.select(F.col(head).cast("string").alias("head")).distinct().collect()] if head else [""]
    if None in heads:
        raise ValueError("rows without a head")
    heads.sort()
    of = F.create_map(*[F.lit(v) for k, h in enumerate(heads) for v in (h, k)])[F.col(head).cast("string")] if head else F.lit(0)
    rows = df.select(
        of.alias("head"), (F.col(group) if group else F.monotonically_increasing_id()).alias("group"), *x,
        F.coalesce(F.col(lower).cast("double"), F.lit(float("-inf"))).alias("low"), F.coalesce(F.col(upper).cast("double"), F.lit(float("inf"))).alias("high"),
    )
    if group:
        sizes = rows.groupBy("group").agg(F.count("*").alias("n"))
        rows = rows.join(sizes, rows["group"].eqNullSafe(sizes["group"])).select("head", *names, "low", "high", (1.0 / F.col("n")).alias("weight"))
    else:
        rows = rows.select("head", *names, "low", "high", F.lit(1.0).alias("weight"))
    return cut(rows), mean, scale, heads


def _in_columns(rows: DataFrame, now: np.ndarray, d: int) -> DataFrame:
    """(i, s): sums of the squared distances' gradient by place of the weight, then of the loss, in columns: no row goes to Python."""
    heads, per = now.shape
    weight = lambda k: F.array(*[F.lit(float(v)) for v in now[:, k]])[F.col("head")] if heads > 1 else F.lit(float(now[0, k]))
    rows = rows.withColumn("v", sum((F.col(f"x{i}") * weight(i) for i in range(d)), weight(d)))
    under, over = F.greatest(F.col("low") - F.col("v"), F.lit(0.0)), F.greatest(F.col("v") - F.col("high"), F.lit(0.0))
    rows = rows.withColumn("by", 2 * F.col("weight") * (over - under)).withColumn("loss", F.col("weight") * (under * under + over * over))
    cells = [*[F.sum(F.col("by") * F.col(f"x{i}")) for i in range(d)], F.sum("by"), F.sum("loss")]
    sums = rows.groupBy("head").agg(F.array(*cells).alias("s")).select("head", F.posexplode("s").alias("k", "s"))
    return sums.select(F.when(F.col("k") < per, F.col("head") * per + F.col("k")).otherwise(heads * per).cast("long").alias("i"), "s")


def fit_intervals(df: DataFrame, features: list[str], lower: str, upper: str, group: str | None = None, head: str | None = None, loss: str = "hinge", alpha: float = 0.01, steps: int = 200, rate: float = RATE, floor: float = 0.05) -> Fit:
    """Fit linear heads to bounds; ``alpha`` weighs the mean square of the coefficients.

    Starts at zero weights and the median bound (the lower one where known). Null heads aren't allowed with ``head``.
    """
    if loss not in ("hinge", "normal") or alpha < 0 or steps < 1:
        raise ValueError("loss is hinge or normal, alpha not negative, steps positive")
    rows, mean, scale, heads = _prepared(df, features, lower, upper, group, head)
    d, two = len(features), loss == "normal"
    start = median(rows.select(F.when(F.col("low") > float("-inf"), F.col("low")).otherwise(F.col("high")).alias("b")), "b")
    total = rows.agg(F.sum("weight")).first()[0]
    size = len(heads) * (d + 1) * (1 + two)  # each head: coefficients, intercept; and the same of its scale
    at = {h: k * (d + 1) * (1 + two) for k, h in enumerate(heads)}
    starts = list(at.values())
    w = np.zeros(size)
    for h in heads:
        w[at[h] + d] = start

    def gradient(now: np.ndarray) -> np.ndarray:
        """The sums over all rows: of the gradient, then of the loss."""
        if not two:
            return totals(_in_columns(rows, now.reshape(len(heads), -1), d))
        shared = rows.sparkSession.sparkContext.broadcast(now)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(size + 1)
            for batch in batches:
                x = np.column_stack([*(batch.column(f"x{i}").to_numpy() for i in range(d)), np.ones(batch.num_rows)])
                low, high, weight = (batch.column(c).to_numpy() for c in ("low", "high", "weight"))
                place = batch.column("head").to_numpy()
                for h, k in enumerate(starts):
                    own = place == h if len(starts) > 1 else slice(None)
                    if not len(weight[own]):
                        continue
                    xs, v = x[own], x[own] @ shared.value[k : k + d + 1]
                    z = xs @ shared.value[k + d + 1 : k + 2 * d + 2]
                    each, by_mean, by_scale = normal_loss(v, np.logaddexp(z, 0) + floor, low[own], high[own])
                    sums[k + d + 1 : k + 2 * d + 2] += xs.T @ (weight[own] * by_scale / (1 + np.exp(-z)))
                    sums[k : k + d + 1] += xs.T @ (weight[own] * by_mean)
                    sums[-1] += weight[own] @ each
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(sums)], names=["i", "s"])

        return totals(rows.mapInArrow(run, "i long, s double"))

    def totals(sums: DataFrame) -> np.ndarray:
        out = np.zeros(size + 1)
        for r in sums.groupBy("i").agg(F.sum("s").alias("s")).collect():  # a number a weight
            out[r["i"]] = r["s"]
        return out / total

    coefficient = np.array([k % (d + 1) < d for k in range(size)])  # intercepts are free
    m, v, losses = np.zeros(size), np.zeros(size), []
    for t in range(1, steps + 1):
        g = gradient(w)
        losses.append(float(g[-1] + alpha * (w[coefficient] ** 2).sum() / max(1, d)))
        if not math.isfinite(losses[-1]):
            raise ValueError("the loss isn't finite")
        g = g[:-1] + np.where(coefficient, 2 * alpha * w / max(1, d), 0)
        m, v = BETA_1 * m + (1 - BETA_1) * g, BETA_2 * v + (1 - BETA_2) * g * g
        w = w - rate * (m / (1 - BETA_1**t)) / (np.sqrt(v / (1 - BETA_2**t)) + TINY)
    part = lambda h, k: w[at[h] + k * (d + 1) : at[h] + (k + 1) * (d + 1)].tolist()
    return Fit(features, mean, scale, {h: part(h, 0)[:-1] for h in heads}, {h: part(h, 0)[-1] for h in heads}, {h: part(h, 1) for h in heads} if two else {}, floor, losses)


def predict(df: DataFrame, fit: Fit, head: str | None = None, out: str = "predicted", deviation: str | None = None) -> DataFrame:
    """The rows with their predicted value, by their head; null for a head that wasn't fitted."""
    choose = lambda f: F.coalesce(*[F.when(F.col(head).cast("string") == h, f(h)) for h in fit.intercept]) if head else f("")
    got = df.withColumn(out, choose(fit.value))
    return got.withColumn(deviation, choose(fit.deviation)) if deviation else got


def require_apart(training: DataFrame, validation: DataFrame, group: str) -> None:
    """An error if a group stands on both sides."""
    both = training.select(group).distinct().join(validation.select(group).distinct(), group, "left_semi").limit(3).collect()
    if both:
        raise ValueError(f"groups on both sides: {[r[0] for r in both]}")
