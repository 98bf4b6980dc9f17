"""How a set compares to a reference set: coverage by neighbour balls, copies, kernel entropy, conformity, divergences.

Definitions are the published ones: improved precision and recall (balls to the k-th neighbour), authenticity
(farther from its nearest reference row than that row is from its own), kernel entropy by random Fourier
features, conformal p-values of a density, Kullback-Leibler divergence of histograms with one count added to
each bin, and the mean normalised edit distance to k others drawn by a hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .graph import cut
from .neighbours import LEAF, covered, nearest
from .rank import ordinal


def radii(df: DataFrame, key: str, vector: str, k: int, leaf: int = LEAF) -> DataFrame:
    """(key, vector, radius): the distance to the k-th nearest other row; rows with fewer others are left out."""
    near = nearest(df, df, key, vector, k, itself=False, leaf=leaf)
    reach = near.where(F.size("near") == k).select(F.col(key).alias("_k"), F.element_at("near", k)["d"].alias("radius"))
    return df.select(key, vector).join(reach, F.col(key) == F.col("_k")).drop("_k")


def coverage(df: DataFrame, reference: DataFrame, key: str, vector: str, k: int = 5, leaf: int = LEAF) -> DataFrame:
    """precision: the share of rows inside a ball of the reference; recall: the share of the reference inside a ball of the rows."""
    # all pairs lie behind the radii, and an index reads its rows three times
    share = lambda a, b, name: covered(a, cut(radii(b, key, vector, k, leaf)), key, vector, "radius", leaf).agg(F.avg((F.col("balls") > 0).cast("double")).alias(name))
    return share(df, reference, "precision").crossJoin(share(reference, df, "recall"))  # one row each


def authenticity(df: DataFrame, reference: DataFrame, key: str, vector: str, leaf: int = LEAF) -> DataFrame:
    """The share of rows farther from their nearest reference row than that row is from its nearest other one."""
    own = radii(reference, key, vector, 1, leaf).select(F.col(key).alias("_r"), "radius")
    near = nearest(df, reference, key, vector, 1, leaf=leaf).select(key, F.col("near")[0]["d"].alias("d"), F.col("near")[0]["id"].alias("_n"))
    return near.join(own, F.col("_n") == F.col("_r")).agg(F.avg((F.col("d") > F.col("radius")).cast("double")).alias("authenticity"))


def fourier_weights(width: int, features: int, bandwidth: float, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(width, features)) / bandwidth


def kernel_entropy(df: DataFrame, vector: str, width: int, bandwidth: float, features: int = 256, seed: int = 42, order: float = 2.0) -> float:
    """exp of the Rényi entropy of the kernel matrix's eigenvalues: how many modes the rows have.

    A Gaussian kernel is its random cosines and sines; their second moments, (2 x features)^2 numbers, are
    summed in tasks and then by Spark, and have the same eigenvalues as the rows' kernel matrix.
    """
    w = df.sparkSession.sparkContext.broadcast(fourier_weights(width, features, bandwidth, seed))
    size = 2 * features

    def run(batches):
        total, n = np.zeros((size, size)), 0
        for batch in batches:
            z = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width) @ w.value
            f = np.concatenate([np.cos(z), np.sin(z)], axis=1)
            total, n = total + f.T @ f, n + len(f)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(np.full(size, n)), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "n", "row"])

    sums = df.select(F.col(vector).cast("array<double>").alias("x")).where(F.size("x") == width).mapInArrow(run, "i long, n long, row array<double>")
    cells = sums.select("i", "n", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    got = cells.toArrow()  # (2 x features)^2 rows
    n = got.column("n")[0].as_py() if got.num_rows else 0
    if not n:
        raise ValueError("no vectors of that width")
    c = np.zeros((size, size))
    c[got.column("i").to_numpy(), got.column("j").to_numpy()] = got.column("v").to_numpy()
    e = np.maximum(np.linalg.eigvalsh(c / (n * features)), 0)
    e = e[e > 0]
    return float(np.exp(-(e * np.log(e)).sum()) if order == 1 else (e**order).sum() ** (1 / (1 - order)))


def histogram_kl(df: DataFrame, reference: DataFrame, value: Column, width: float = 1.0) -> DataFrame:
    """kl: of the rows' histogram to the reference's, over the bins that either has, each count one higher."""
    bins = lambda d, own: d.select(F.floor(value / width).alias("b"), F.lit(own).alias("own")).where("b IS NOT NULL")
    h = bins(df, 1).unionByName(bins(reference, 0)).groupBy("b").agg((F.sum("own") + 1).alias("p"), (F.sum(1 - F.col("own")) + 1).alias("q"))
    s = h.agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    p, q = F.col("p") / F.col("sp"), F.col("q") / F.col("sq")
    return h.crossJoin(F.broadcast(s)).agg(F.sum(p * F.ln(p / q)).alias("kl"))  # one row


def diversity(df: DataFrame, key: str, text: str, k: int = 5, seed: int = 42) -> DataFrame:
    """diversity: the mean over rows of the edit distance to k others, over the longer length.

    The j-th other of the row at place i (by key, from 0) is at (i + 1 + h mod (n - 1)) mod n, h of the SHA-256 of seed:i:j.
    """
    rows = ordinal(df.where(F.col(text).isNotNull()).select(key, F.col(text).alias("t")), key, "i")
    n = rows.count()
    if n < 2:
        return rows.agg(F.lit(None).cast("double").alias("diversity"))
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("i").cast("string"), F.col("j").cast("string")), 256), 1, 15), 16, 10).cast("long")
    drawn = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("o", (F.col("i") + 1 + h % (n - 1)) % n)
    other = rows.select(F.col("i").alias("o"), F.col("t").alias("u"))
    d = F.levenshtein("t", "u") / F.nullif(F.greatest(F.length("t"), F.length("u")), F.lit(0))
    return drawn.join(other, "o").agg(F.avg(F.coalesce(d, F.lit(0.0))).alias("diversity"))


def conformity(df: DataFrame, reference: DataFrame, key: str, columns: list[str], step: float, bandwidth: float, folds: int = 5, reach: int = 12) -> DataFrame:
    """conformity: the mean conformal p-value of the rows under a density of the reference.

    The density at a cell of side ``step`` is the sum of Gaussian weights of the fitting rows' cells up to
    ``reach`` cells away. Each fold (hash of the key) of the reference is scored under the others; a row's p is
    (1 + scores of the fold not above its own) / (1 + rows of the fold). Cells, not rows, are joined.
    """
    cell = [F.floor(F.col(c) / step).cast("long").alias(f"c{i}") for i, c in enumerate(columns)]
    names = [f"c{i}" for i in range(len(columns))]
    known = lambda d: d.dropna(subset=columns)
    fold = F.pmod(F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 15), 16, 10).cast("long"), F.lit(folds))
    ref = known(reference).select(*cell, fold.alias("fold")).groupBy(*names, "fold").agg(F.count("*").alias("n"))
    fits = ref.select(*names, F.explode(F.array(*[F.lit(f) for f in range(folds)])).alias("to"), "fold", "n").where("fold <> to").groupBy(*names, "to").agg(F.sum("n").alias("n"))
    own = known(df).select(*cell).groupBy(*names).agg(F.count("*").alias("n"))
    asked = ref.select(*names, F.col("fold").alias("to"), F.col("n").alias("cal"), F.lit(0).cast("long").alias("new")).unionByName(own.select(*names, F.explode(F.array(*[F.lit(f) for f in range(folds)])).alias("to"), F.lit(0).cast("long").alias("cal"), F.col("n").alias("new")))
    asked = asked.groupBy(*names, "to").agg(F.sum("cal").alias("cal"), F.sum("new").alias("new"))
    spread = fits
    away = F.lit(0.0)
    for c in names:
        spread = spread.withColumn(f"o{c}", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
        away = away + F.col(f"o{c}") * F.col(f"o{c}")
    weight = F.col("n") * F.exp(-away * (step * step) / (2 * bandwidth * bandwidth))
    spread = spread.select("to", *[(F.col(c) + F.col(f"o{c}")).alias(c) for c in names], weight.alias("w"))
    density = asked.join(spread, ["to", *names], "left").groupBy("to", *names).agg(F.round(F.coalesce(F.sum("w"), F.lit(0.0)), 9).alias("d"), F.first("cal").alias("cal"), F.first("new").alias("new"))
    scores = density.groupBy("to", "d").agg(F.sum("cal").alias("cal"), F.sum("new").alias("new"))
    below = F.sum("cal").over(W.partitionBy("to").orderBy("d").rowsBetween(W.unboundedPreceding, 0))
    placed = scores.select("to", "new", below.alias("below"), F.sum("cal").over(W.partitionBy("to")).alias("all"))
    p = placed.groupBy("to").agg((F.sum(F.col("new") * (1 + F.col("below")) / (1 + F.col("all"))) / F.sum("new")).alias("p"))
    return p.agg(F.avg("p").alias("conformity"))
