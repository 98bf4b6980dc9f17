"""Neighbours, principal axes and clusters of embedding columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .graph import over_blocks


def knn_median(df: DataFrame, reference: DataFrame, key: str, vector: str, k: int = 5, most_rows: int = 200_000) -> DataFrame:
    """Median Euclidean distance to the k nearest reference vectors; exact at any size of the reference.

    The reference is broadcast in blocks of ``most_rows``; each block is merged into a row's k smallest distances.
    """
    import numpy as np
    import pyarrow as pa

    schema = f"{key} {df.schema[key].dataType.simpleString()}, {vector} {df.schema[vector].dataType.simpleString()}, _near array<double>"

    def merged(state: DataFrame, block: list) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(np.array(block, float))

        def run(batches):
            ref = shared.value
            norm = (ref * ref).sum(axis=1)
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    x = np.array(part.column(1).to_pylist(), float)
                    d = np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + norm - 2 * x @ ref.T, 0))
                    d = np.partition(d, min(k, len(ref)) - 1, axis=1)[:, :k]
                    d = np.sort(np.concatenate([np.array(part.column(2).to_pylist(), float), d], axis=1), axis=1)[:, :k]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(d.tolist(), pa.list_(pa.float64()))], names=[key, vector, "_near"])

        return state.mapInArrow(run, schema)

    state = df.select(key, vector, F.array().cast("array<double>").alias("_near")).where(F.col(vector).isNotNull())
    state = over_blocks(state, reference.select(vector).where(F.col(vector).isNotNull()), most_rows, merged)
    n = F.size("_near")
    at = lambda i: F.get("_near", F.floor(i).cast("int"))
    return state.select(key, ((at((n - 1) / 2) + at(n / 2)) / 2).alias("distance"))


def pca(df: DataFrame, vector: str, k: int, out: str = "projected", fit_on: DataFrame | None = None) -> DataFrame:
    """Projection on the k first principal axes of the reference rows (all rows if none are given), centred by their mean."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    known = lambda d: d.where(F.col(vector).isNotNull()).withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    base, data = known(fit_on if fit_on is not None else df), known(df)
    centre = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(base)
    axes = PCA(k=k, inputCol="_c", outputCol="_p").fit(centre.transform(base))
    return axes.transform(centre.transform(data)).withColumn(out, vector_to_array("_p")).drop("_v", "_c", "_p")


def kmeans(df: DataFrame, vector: str, k: int, seed: int = 42, out: str = "cluster") -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol=out).fit(data).transform(data).drop("_v")


def mean_pool(tokens: Column, first: int = 1, last: int = 1) -> Column:
    """Mean of an array of token vectors without the first and last so many (boundaries); null if none is left."""
    inner = F.slice(tokens, first + 1, F.greatest(F.size(tokens) - first - last, F.lit(0)))
    width = F.size(F.get(inner, F.lit(0)))
    zero = F.transform(F.sequence(F.lit(1), width), lambda _: F.lit(0.0))
    total = F.aggregate(inner, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.when(F.size(inner) > 0, F.transform(total, lambda x: x / F.size(inner)))


def cached_vectors(df: DataFrame, cache: DataFrame, key: str, vector: str) -> DataFrame:
    """The rows with their vector from a cache; one that is missing is an error when it is read."""
    got = df.join(cache.select(key, vector), key, "left")
    miss = F.raise_error(F.concat(F.lit("not in the cache: "), F.col(key).cast("string"))).cast(cache.schema[vector].dataType)
    return got.withColumn(vector, F.coalesce(F.col(vector), miss))


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns less their means over their population deviations; a constant column becomes 0."""
    s = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    z = {c: F.coalesce((F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(0.0)) for c in columns}
    return df.crossJoin(F.broadcast(s)).withColumns(z).select(*df.columns)  # one row
