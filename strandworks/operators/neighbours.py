"""Exact nearest neighbours and ball membership between two tables of vectors, by a tree of leaves with bounds.

A tree of hyperplanes is fitted to a bounded sample of the reference and applied to all of it; leaves of more
than ``LEAF`` rows are split by a hash. A row first visits the leaf it would lie in; the distance of its k-th
neighbour there then decides which leaves, by their centres and radii, it visits besides. So no table passes
the driver or is broadcast, only the tree, which has at most ``MOST`` leaves. Distances that decide are worked
out from differences, coordinate by coordinate. In data without clusters many leaves are visited.

Vectors that are null or of another width than the reference's commonest have no neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .graph import cut

LEAF, SAMPLE, MOST = 2048, 8192, 4096
#: Leaves of a table whose rows may go to all of them, rows of the largest leaf, and rows that visit a leaf at once.
FEW, LARGEST, BUNCH = 16, 131_072, 65_536


def _numbers(df: DataFrame, vector: str):
    """Vectors of floats stay floats while they travel; tasks work in double precision."""
    single = isinstance(df.schema[vector].dataType, T.ArrayType) and isinstance(df.schema[vector].dataType.elementType, T.FloatType)
    return F.col(vector) if single else F.col(vector).cast("array<double>")


class Tiles:
    """Tables of the squared distances of some rows of x to some of y, each less a number of the row of y: small enough for a core's cache.

    One product of matrices gives a table whole, in single precision where the numbers' size allows it. ``room``
    is twice what rounding may add or take for a row of x; what lies that near to a limit is worked out exactly.
    """

    X, Y = 256, 2048

    def __init__(self, x: np.ndarray, y: np.ndarray, less: np.ndarray):
        with np.errstate(over="ignore", invalid="ignore"):
            xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
            most = yy.max() + less.max()
            kind = np.float32 if 1e-20 < xx.max() + most < 1e30 else np.float64
            self.x = np.column_stack([x, xx, np.ones(len(x))]).astype(kind)
            self.y = np.column_stack([-2 * y, np.ones(len(y)), yy - less]).astype(kind)
            self.room = (2 * (x.shape[1] + 8) * np.finfo(kind).eps * (xx + most)).astype(kind)

    def table(self, i: int, j: int) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            return self.x[i : i + self.X] @ self.y[j : j + self.Y].T


def _places(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the marks; numpy's nonzero of a matrix takes longer than the matrix product."""
    return np.divmod(np.flatnonzero(marks), marks.shape[1])


def _exact_pairs(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.concatenate([exact(x[i[a : a + 65_536]], y[j[a : a + 65_536]]) for a in range(0, len(i), 65_536)]) if len(i) else np.zeros(0)


def first_neighbours(x: np.ndarray, y: np.ndarray, k: int, bound: np.ndarray, own: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, d): of each row of x the k nearest rows of y not beyond its bound, of equal ones the first; ``own``: pairs that don't count, by row of x."""
    tiles, out, none = Tiles(x, y, np.zeros(1)), [], (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    for at in range(0, len(x), tiles.X):
        rows = x[at : at + tiles.X]
        limit, room = bound[at : at + tiles.X] ** 2 * (1 + 1e-12), tiles.room[at : at + tiles.X]
        a, b = np.searchsorted(own[0], [at, at + tiles.X])
        row, place = own[0][a:b] - at, own[1][a:b]
        best, new, n = none, [], 0
        for to in range(0, len(y), tiles.Y):
            s = tiles.table(at, to)
            here = (place >= to) & (place < to + tiles.Y)
            s[row[here], place[here] - to] = np.inf
            if np.isinf(limit).any() and s.shape[1] >= k:
                limit = np.fmin(limit, np.partition(s, k - 1, axis=1)[:, k - 1])
            i, j = _places(s <= (limit + room)[:, None].astype(s.dtype))
            some = np.isfinite(s[i, j])
            new.append((i[some], j[some] + to))
            n += len(new[-1][0])
            if n > 65_536 or to + tiles.Y >= len(y):
                i, j = (np.concatenate(c) for c in zip(*new))
                i, j, d = (np.concatenate(c) for c in zip(best, (i, j, _exact_pairs(rows, y, i, j))))
                order = np.lexsort((j, d, i))
                i, j, d = i[order], j[order], d[order]
                nth = np.arange(len(i)) - np.searchsorted(i, i)
                limit[i[nth == k - 1]] = np.fmin(limit[i[nth == k - 1]], d[nth == k - 1] ** 2 * (1 + 1e-12))
                best, new, n = tuple(c[nth < k] for c in (i, j, d)), [], 0
        out.append((best[0] + at, *best[1:]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else none


def balls_around(x: np.ndarray, y: np.ndarray, r: np.ndarray) -> np.ndarray:
    """In how many balls (y, r) each row of x lies."""
    tiles, total = Tiles(x, y, r * r), np.zeros(len(x), np.int64)
    for at in range(0, len(x), tiles.X):
        rows, room = x[at : at + tiles.X], tiles.room[at : at + tiles.X]
        for to in range(0, len(y), tiles.Y):
            s = tiles.table(at, to)
            i, j = _places(s <= room[:, None])
            inside = s[i, j] <= -room[i]
            edge = np.flatnonzero(~inside)
            inside[edge] = _exact_pairs(rows, y, i[edge], j[edge] + to) <= r[j[edge] + to]
            total[at : at + len(rows)] += np.bincount(i[inside], minlength=len(rows))
    return total


class Leaves:
    """Hyperplanes, and the centre of each leaf."""

    def __init__(self, sample: np.ndarray, rows: int, leaf: int = LEAF, most: int = MOST):
        r = np.random.default_rng(1)
        self.cuts: dict[int, tuple[np.ndarray, float]] = {}
        self.centres: dict[int, np.ndarray] = {}
        todo, parts = [(1, np.arange(len(sample)))], 1
        while todo:
            node, own = todo.pop(0)
            share = rows * len(own) / max(1, len(sample))
            if share > leaf and parts < most and len(own) > 3:
                a, b = sample[r.choice(own, 2, replace=False)]
                p = sample[own] @ (b - a)
                limit = float(np.median(p))
                if (p <= limit).any() and (p > limit).any():
                    self.cuts[node] = b - a, limit
                    todo += [(2 * node, own[p <= limit]), (2 * node + 1, own[p > limit])]
                    parts += 1
                    continue
            self.centres[node] = sample[own].mean(axis=0) if len(own) else np.zeros(sample.shape[1])

    def of(self, x: np.ndarray) -> np.ndarray:
        out, todo = np.ones(len(x), np.int64), [(1, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            if node in self.cuts:
                way, limit = self.cuts[node]
                right = x[own] @ way > limit
                todo += [(2 * node, own[~right]), (2 * node + 1, own[right])]
            else:
                out[own] = node
        return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs, to within rounding of large squares."""
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * x @ y.T, 0)


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows side by side."""
    return np.sqrt(((x - y) ** 2).sum(axis=-1))


class Index:
    """A reference table in leaves: (key, vector) and, for balls, a radius."""

    def __init__(self, reference: DataFrame, key: str, vector: str, radius: str | None = None, leaf: int = LEAF):
        spark = reference.sparkSession
        self.kind = reference.schema[key].dataType
        rows = reference.select(F.col(key).alias("id"), _numbers(reference, vector).alias("x"), (F.col(radius) if radius else F.lit(0.0)).cast("double").alias("r")).where("id IS NOT NULL AND x IS NOT NULL AND r IS NOT NULL")
        widths = rows.groupBy(F.size("x").alias("w")).count().orderBy(F.desc("count"), "w").first()
        self.width, n = (widths["w"], widths["count"]) if widths else (0, 0)
        self.rows = rows = rows.where(F.size("x") == self.width)
        # a row that visits all leaves is copied to each: their number must not grow with the table
        leaf = max(leaf, min(LARGEST, -(-n // FEW))) if leaf == LEAF else leaf
        share = max(1, n // SAMPLE)
        picked = rows.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(share)) == 0).select("x").limit(SAMPLE).toArrow()
        self.leaves = Leaves(matrix(picked.column("x").combine_chunks(), self.width) if picked.num_rows else np.zeros((0, self.width)), n, leaf)
        self.tree = tree = spark.sparkContext.broadcast(self.leaves)
        width = self.width

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column("x"), width)
                at = tree.value.of(x)
                far = exact(x, np.array([tree.value.centres[k] for k in at.tolist()]).reshape(len(x), width))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(far)], names=["id", "x", "r", "leaf", "far"])

        placed = cut(rows.mapInArrow(place, T.StructType([*rows.schema.fields, T.StructField("leaf", T.LongType()), T.StructField("far", T.DoubleType())])))
        self.stats = placed.groupBy("leaf").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max("r").alias("r")).orderBy("leaf").collect()  # at most MOST
        parts = F.create_map(*[F.lit(v) for s in self.stats for v in (s["leaf"], max(1, -(-s["n"] // leaf)))]) if self.stats else F.create_map().cast("map<bigint,int>")
        self.placed = placed.withColumn("parts", parts[F.col("leaf")]).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
        self.parts = {s["leaf"]: max(1, -(-s["n"] // leaf)) for s in self.stats}

    def going(self, rows: DataFrame, first: bool, bound: str | None) -> DataFrame:
        """(id, x, .., leaf, part): the leaf where a row would lie (``first``), or all others that its bound reaches; without a bound, that the balls of the leaf reach."""
        stats, parts, width, tree = self.stats, self.parts, self.width, self.tree
        names = rows.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            leaf = np.array([s["leaf"] for s in stats], np.int64)
            centre = np.array([tree.value.centres[k] for k in leaf.tolist()]).reshape(len(leaf), width)
            far, reach = (np.array([s[c] for s in stats], float) for c in ("far", "r"))
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    batch = whole.slice(at, 1024)
                    x = matrix(batch.column("x"), width)
                    own = np.argmin(apart(x, centre), axis=1) if len(leaf) else np.zeros(len(x), int)
                    if first:
                        row, to = np.arange(len(x)), own
                    else:
                        d = np.stack([exact(x, c) for c in centre], axis=1) if len(leaf) else np.zeros((len(x), 0))
                        limit = batch.column(bound).to_numpy(zero_copy_only=False)[:, None] if bound else reach
                        go = (d - far) * (1 - 1e-9) - 1e-9 <= limit
                        if bound:
                            go[np.arange(len(x)), own] = False
                        row, to = np.nonzero(go)
                    if not len(leaf):
                        continue
                    many = np.array([parts[k] for k in leaf[to].tolist()], np.int64)
                    part = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    row, to = np.repeat(row, many), np.repeat(to, many)
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in batch.columns), pa.array(leaf[to]), pa.array(part.astype(np.int32))], names=[*names, "leaf", "part"])

        out = T.StructType([*rows.schema.fields, T.StructField("leaf", T.LongType()), T.StructField("part", T.IntegerType())])
        # rows of a hot leaf are dealt on, each bunch to a copy of the leaf's rows
        return rows.mapInArrow(run, out).withColumn("bunch", F.pmod(F.xxhash64("id", F.lit(11)), F.lit(self.bunches(rows))).cast("int"))

    def bunches(self, rows: DataFrame) -> int:
        if not hasattr(self, "_rows"):
            self._rows = rows.count()
        return max(1, -(-self._rows // BUNCH))

    def met(self, going: DataFrame, rows: DataFrame, work, schema: T.StructType) -> DataFrame:
        """``work(visitors, here)`` for each leaf's part and bunch of visitors."""
        here = self.placed.select("leaf", "part", F.explode(F.sequence(F.lit(0), F.lit(self.bunches(rows) - 1))).alias("bunch"), F.col("id").alias("ref"), F.col("x").alias("y"), "r")
        keys = ["leaf", "part", "bunch"]
        return going.groupBy(*keys).cogroup(here.groupBy(*keys)).applyInArrow(work, schema)


def _rows(df: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    rows = df.select(F.col(key).alias("id"), _numbers(df, vector).alias("x"))
    return rows.where(F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") == width))


def nearest(df: DataFrame, reference: DataFrame, key: str, vector: str, k: int = 5, itself: bool = True, leaf: int = LEAF) -> DataFrame:
    """(key, near): the k nearest reference rows as (d, id), nearest first, ties to the smaller id. ``itself``: whether a row of the same key counts."""
    index = Index(reference, key, vector, leaf=leaf)
    width, kind = index.width, index.kind
    rows = _rows(df, key, vector, width)
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("d", T.DoubleType()), T.StructField("ref", kind)])

    def work(visitors: pa.Table, here: pa.Table) -> pa.Table:
        i = j = np.zeros(0, np.int64)
        d = np.zeros(0)
        if visitors.num_rows and here.num_rows:
            here = here.take(pc.sort_indices(here.column("ref")))
            x, y = (matrix(t.column(c).combine_chunks(), width) for t, c in ((visitors, "x"), (here, "y")))
            bound = visitors.column("bound").to_numpy() if "bound" in visitors.column_names else np.full(len(x), np.inf)
            own: list[tuple[int, int]] = []
            if not itself:
                same: dict = {}
                for at, ref in enumerate(here.column("ref").to_pylist()):
                    same.setdefault(ref, []).append(at)
                own = [(row, at) for row, id_ in enumerate(visitors.column("id").to_pylist()) for at in same.get(id_, ())]
            i, j, d = first_neighbours(x, y, k, bound, tuple(np.array(own, np.int64).reshape(-1, 2).T))
        ids, refs = (t.column(c).combine_chunks().take(pa.array(n)) if t.num_rows else pa.array([], _arrow(kind_)) for t, c, n, kind_ in ((visitors, "id", i, schema["id"].dataType), (here, "ref", j, kind)))
        return pa.table({"id": ids, "d": pa.array(d), "ref": refs})

    def best(found: DataFrame) -> DataFrame:
        return found.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", F.col("ref").alias("id")))), 1, k).alias("near"))

    seed = cut(index.met(index.going(rows, True, None), rows, work, schema))
    bound = best(seed).select(F.col("id").alias("_id"), F.when(F.size("near") == k, F.element_at("near", k)["d"]).alias("bound"))
    more = rows.join(bound, F.col("id") == F.col("_id"), "left").select("id", "x", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    found = seed.unionByName(index.met(index.going(more, False, "bound"), rows, work, schema))
    return best(found).withColumnRenamed("id", key)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def covered(df: DataFrame, balls: DataFrame, key: str, vector: str, radius: str, leaf: int = LEAF) -> DataFrame:
    """(key, balls): in how many balls (key, vector, radius) each row lies; on the border counts."""
    index = Index(balls, key, vector, radius, leaf)
    width = index.width
    rows = _rows(df, key, vector, width)
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("n", T.LongType())])

    def work(visitors: pa.Table, here: pa.Table) -> pa.Table:
        total = np.zeros(visitors.num_rows, np.int64)
        if visitors.num_rows and here.num_rows:
            x, y = (matrix(t.column(c).combine_chunks(), width) for t, c in ((visitors, "x"), (here, "y")))
            total = balls_around(x, y, here.column("r").to_numpy())
        return pa.table({"id": visitors.column("id") if visitors.num_rows else pa.array([], _arrow(schema["id"].dataType)), "n": pa.array(total)})

    counts = index.met(index.going(rows, False, None), rows, work, schema).groupBy("id").agg(F.sum("n").alias("n"))
    return rows.select("id").join(counts.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").select(F.col("id").alias(key), F.coalesce("n", F.lit(0)).alias("balls"))
