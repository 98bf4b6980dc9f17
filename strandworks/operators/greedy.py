"""Selections that depend on what was selected before: diverse heads with limits, ladders, portfolios.

Spark sorts, cuts the head (a parameter) and finds the similarities to references; only the head's rows go
through one task, which takes them in turn. Portfolios take one pass over their keys for each pick.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import kernels
from . import joins, rank
from .graph import cut


@dataclass(frozen=True)
class Step:
    """Limits of one step of a ladder; None: no limit."""

    head: int
    per_cluster: int | None = None
    pairwise: float | None = None


#: Tests of a candidate in the order in which the first that fails is counted.
LADDER_ORDER = ("external", "challenge", "known", "pairwise", "cluster", "hard")
EXPLORATION_ORDER = ("repeated", "hard", "cluster", "challenge", "known", "pairwise")


def _take(rows: pd.DataFrame, k: int, step: Step, order: tuple[str, ...], similarity) -> tuple[list[int], list[float], dict[str, int]]:
    """Positions taken, each one's highest similarity to those before, and how many failed each test first."""
    taken: list[int] = []
    near: list[float] = []
    texts: list[str] = []
    used: dict = {}
    failed = dict.fromkeys(order, 0)
    for i, row in enumerate(rows.head(step.head).itertuples(index=False)):
        top = None
        for test in order:
            if test == "pairwise":
                top = max((similarity(row.s, t) for t in texts), default=0.0)
                bad = step.pairwise is not None and top > step.pairwise
            elif test == "cluster":
                bad = step.per_cluster is not None and used.get(row.cluster, 0) >= step.per_cluster
            elif test == "repeated":
                bad = row.s in texts
            else:
                bad = bool(getattr(row, test))
            if bad:
                failed[test] += 1
                break
        else:
            taken.append(i)
            near.append(top or 0.0)
            texts.append(row.s)
            used[row.cluster] = used.get(row.cluster, 0) + 1
            if len(taken) == k:
                break
    return taken, near, failed


def diverse_top(df: DataFrame, key: str, text: str, score: str, raw: str, k: int, steps: list[Step], flags: dict[str, Column], cluster: str | None = None, order: tuple[str, ...] = LADDER_ORDER, similarity=kernels.local_ratio, short: bool = False) -> DataFrame:
    """(key, place, similarity, step, failed): k rows by score (high first), raw order, text, each passing all tests.

    flags: {"external", "challenge", "known", "hard": whether a row fails}; those not given never fail. The
    first step of the ladder that fills k is taken; if none does, that is an error, or with ``short`` the last
    step's rows. ``failed`` counts, for the step taken, rows by the first test they failed.
    """
    head = max(s.head for s in steps)
    named = [F.coalesce(flags.get(t, F.lit(False)), F.lit(False)).alias(t) for t in ("external", "challenge", "known", "hard")]
    rows = df.where(rank.finite(F.col(score))).orderBy(F.col(score).desc(), raw, text).limit(head)
    rows = rows.select(F.col(key).alias("key"), F.col(text).alias("s"), F.col(score).cast("double").alias("score"), F.col(raw).cast("long").alias("raw"), (F.col(cluster).cast("string") if cluster else F.lit("")).alias("cluster"), *named)

    def select(_: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "raw", "s"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        for n, step in enumerate(steps):
            taken, near, failed = _take(group, k, step, order, similarity)
            if len(taken) == k:
                break
        if len(taken) < k and not short:
            raise ValueError(f"infeasible: selected {len(taken)} of {k}")
        counts = ",".join(f"{t}={n}" for t, n in failed.items() if n)
        return pd.DataFrame({"key": group["key"].iloc[taken], "place": range(1, len(taken) + 1), "similarity": near, "step": n, "failed": counts})

    kind = df.schema[key].dataType.simpleString()
    return rows.groupBy(F.lit(1).alias("_g")).applyInPandas(select, f"key {kind}, place int, similarity double, step int, failed string").withColumnRenamed("key", key)


def reference_flags(df: DataFrame, key: str, text: str, challenge: DataFrame, known: DataFrame, challenge_max: float, known_max: float) -> DataFrame:
    """Add near_challenge and near_known: the highest common-subsequence ratio, and local similarity, to reference texts is above the limits.

    Only whether a limit is passed is looked for, so length and letter bounds cut most alignments.
    """
    ids = df.select(F.col(key).alias("id"), F.col(text).alias("s"))
    refs = lambda r: r.select(F.col(text).alias("s"))
    a = joins.above(ids, refs(challenge), "s", challenge_max).select(F.col("id").alias("_a")).distinct()
    b = joins.above(ids, refs(known), "s", known_max, local=True).select(F.col("id").alias("_b")).distinct()
    out = df.join(a, F.col(key) == F.col("_a"), "left").join(b, F.col(key) == F.col("_b"), "left")
    return out.withColumn("near_challenge", F.col("_a").isNotNull()).withColumn("near_known", F.col("_b").isNotNull()).drop("_a", "_b")


def adopted_top(pool: DataFrame, library: DataFrame, key: str, text: str, consensus: str, raw: str, k: int, head: int, flags: dict[str, Column]) -> DataFrame:
    """k rows of a library (text) by the percentile score of the consensus within it; every library text must be in the pool."""
    joins.require_covered(library.select(text), pool.select(text), [text])
    rows = rank.percentile_score(pool.join(library.select(text), text, "left_semi"), consensus, "_score")
    return diverse_top(rows, key, text, "_score", raw, k, [Step(head)], flags, order=EXPLORATION_ORDER)


def interleave(df: DataFrame, key: str, scores: list[str], ties: list[str]) -> DataFrame:
    """(key, place): rankings by each score (high first) read in turn, each giving its best that wasn't read yet.

    Turn t takes from ranking t modulo their number. What a ranking gives depends on the others' earlier
    turns, so the rank table (one row a key, of a bounded pool) is read in one task.
    """
    table = df.select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(f"s{i}") for i, c in enumerate(scores)], *[F.col(c).alias(f"t{i}") for i, c in enumerate(ties)])

    def read(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        queues = [rows.sort_values([f"s{i}", *(f"t{j}" for j in range(len(ties)))], ascending=[False] + [True] * len(ties)).index.to_list()[::-1] for i in range(len(scores))]
        left, out = set(rows.index), []
        while left:
            queue = queues[len(out) % len(queues)]
            while (i := queue.pop()) not in left:
                pass
            left.discard(i)
            out.append(i)
        return pd.DataFrame({"key": rows["key"].loc[out].to_numpy(), "place": range(1, len(out) + 1)})

    kind = df.schema[key].dataType.simpleString()
    return table.groupBy(F.lit(1).alias("_g")).applyInPandas(read, f"key {kind}, place int").withColumnRenamed("key", key)


def quota_portfolio(df: DataFrame, key: str, text: str, arms: list[str], consensus: str, raw: str, k: int, fraction: float, step: Step, flags: dict[str, Column], cluster: str | None = None) -> DataFrame:
    """(key, place, role): round(k * fraction) specialists, read in turn from the arms' rankings, the rest by consensus; no specialist may be lost."""
    n = round(k * fraction)
    if not 0 < n < k:
        raise ValueError("specialists and consensus both need a place")
    total = df.count()
    turns = df.join(interleave(df, key, arms, [raw, text]), key).withColumn("_s", (F.lit(total) - F.col("place") + 1) / total).drop("place")
    first = diverse_top(turns, key, text, "_s", raw, n, [step], flags, cluster, EXPLORATION_ORDER).select(F.col(key).alias("_k"), F.col("place").alias("_p"))
    rest = rank.pct_rank(df, consensus, "_c").join(first, F.col(key) == F.col("_k"), "left").withColumn("_s", F.coalesce(2 + n - F.col("_p") + 1, F.col("_c")))
    got = diverse_top(rest, key, text, "_s", raw, k, [step], flags, cluster, EXPLORATION_ORDER).join(first, F.col(key) == F.col("_k"), "left")
    if got.where("_k IS NOT NULL").count() != n:
        raise ValueError("infeasible: a specialist was lost")
    return got.select(key, "place", F.when(F.col("_k").isNotNull(), "specialist").otherwise("consensus").alias("role"))


def portfolio(hits: DataFrame, key: str, scenario: str, value: str, k: int, tail: float | None = None, groups: DataFrame | None = None, cap: int | None = None) -> DataFrame:
    """(key, place): k keys, one after another, that raise the mean of the scenarios' running totals most, or of their lowest ceil(tail * n).

    hits: (key, scenario, value), complete; ties to the smaller key; at most ``cap`` keys of a group (key,
    grp). Each pick is one pass over the keys' vectors: tasks return their best key, the best of these is
    taken. So the pool may have any size; a scenario's total and the keys taken are on the driver.
    """
    import numpy as np
    import pyarrow as pa

    kind = hits.schema[key].dataType
    x = F.struct(F.col(scenario).cast("string").alias("s"), F.col(value).cast("double").alias("v"))
    wide = hits.groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_list(x)).alias("x"))  # a value a scenario
    of = groups.select(F.col(key).alias("_k"), F.col("grp").cast("string").alias("grp")).dropDuplicates(["_k"]) if groups is not None else None
    wide = wide.join(of, F.col("key") == F.col("_k"), "left").drop("_k") if of is not None else wide.withColumn("grp", F.lit(None).cast("string"))
    wide = cut(wide.select("key", "grp", F.transform("x", lambda r: r["s"]).alias("names"), F.transform("x", lambda r: r["v"]).alias("v")))
    first = wide.select("names").first()
    n = len(first["names"]) if first else 0
    if first and not wide.where(~F.col("names").eqNullSafe(F.array(*map(F.lit, first["names"]))) | F.exists("v", lambda a: a.isNull() | F.isnan(a))).isEmpty():
        raise ValueError("every key needs a value in every scenario")
    worst = n if tail is None else max(1, int(np.ceil(tail * n - 1e-12)))
    total, taken, used = np.zeros(n), [], {}

    def best(rows: DataFrame, now: np.ndarray) -> DataFrame:
        def run(batches):
            for batch in batches:
                v = batch.column("v").flatten().to_numpy().reshape(-1, n)
                gain = np.sort(v + now, axis=1)[:, :worst].mean(axis=1)
                top = np.flatnonzero(gain == gain.max())  # ties too: which key is smaller is Spark's to say
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(top)) for c in ("key", "grp", "v")), pa.array(gain[top])], names=["key", "grp", "v", "gain"])

        return rows.select("key", "grp", "v").mapInArrow(run, T.StructType([T.StructField("key", kind), T.StructField("grp", T.StringType()), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("gain", T.DoubleType())]))

    for _ in range(k):
        full = [g for g, c in used.items() if cap is not None and c >= cap]
        rows = wide.where(~F.col("key").isin(taken)) if taken else wide
        if full:
            rows = rows.where(~F.coalesce("grp", F.lit("")).isin(full))
        got = best(rows, total).orderBy(F.desc("gain"), "key").limit(1).collect()
        if not got:
            raise ValueError("too few keys under the cap")
        taken.append(got[0]["key"])
        total = total + np.array(got[0]["v"])
        used[got[0]["grp"] or ""] = used.get(got[0]["grp"] or "", 0) + 1
    out = T.StructType([T.StructField(key, kind), T.StructField("place", T.IntegerType())])
    return hits.sparkSession.createDataFrame([(v, p + 1) for p, v in enumerate(taken)], out)  # k rows
