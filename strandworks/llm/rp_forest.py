"""Embedding near-duplicates by a forest of random-projection trees with spill overlap.

Equal vectors are one class. Each tree splits the unit vectors again and again: every level has a random
direction, every node its own threshold, the median of a bounded sample's projections there (below the
sample's depth: the projection of its last mean). A vector within ``SPILL`` standard deviations of a
random unit vector's projection of a threshold goes to both sides, unless most of the node would, when
the node is split no further. Trees are as deep as the number of classes asks for (``LEAF`` a leaf), and
as many as recall asks for: pairs at exactly the least cosine are planted beside sampled vectors, and
trees are added until ``RECALL`` of these meet in a leaf (at most ``TREES``), so recall doesn't fall as
tables grow. Every class is in a leaf of every tree; pairs are compared within leaves: in single precision
first, and in double precision all that are within its error of the threshold. Leaves above ``BLOCK``
rows are compared by pairs of blocks.

A pair that meets in several leaves counts only in the first tree and leaf that hold both, which each
leaf works out from the trees; so links are counted without listing pairs, and a leaf returns a sum and
one edge to a representative for each class.

Rows: a null id, and vectors that are null, zero, empty or hold null or non-finite components, link with
nothing and stand alone; vectors of other lengths don't link with each other; repeated rows count as
separate copies; no rows give no rows; other columns aren't used.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import connected_components, cut, drop_cut
from .simhash import merge

TREES, LEAF, BLOCK, SAMPLE, SPILL, RECALL, MIN_COS = 32, 1024, 2048, 8192, 0.16, 0.999, 0.9


class Forest:
    """Directions and thresholds of all trees; unit vectors in, leaves out."""

    def __init__(self, sample: np.ndarray, rows: int, min_cos: float = MIN_COS, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, recall: float = RECALL, seed: int = 1):
        self.depth = max(0, math.ceil(math.log2(max(1, rows) / leaf)))
        d = sample.shape[1]
        self.spill, r = spill / math.sqrt(max(1, d)), np.random.default_rng(seed)
        self.ways: list[np.ndarray] = []
        self.cuts: list[dict[int, float]] = []
        self.means: list[dict[int, np.ndarray]] = []
        a = sample[:2048]
        w = r.normal(size=a.shape)
        w -= (w * a).sum(axis=1, keepdims=True) * a
        b = min_cos * a + math.sqrt(max(0.0, 1 - min_cos**2)) * w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-12)
        met = np.zeros(len(a), bool)
        while not self.ways or len(self.ways) < trees and met.size and met.mean() < recall and d > 1:
            self._grow(sample, r)
            (at, la), (bt, lb) = (self.leaves(x, len(self.ways) - 1) for x in (a, b))
            met[np.intersect1d(at * (1 << self.depth) + (la - (1 << self.depth)), bt * (1 << self.depth) + (lb - (1 << self.depth))) >> self.depth] = True

    def _grow(self, sample: np.ndarray, r: np.random.Generator) -> None:
        """One more tree."""
        d = sample.shape[1]
        way = r.normal(size=(d, max(1, self.depth)))
        way /= np.linalg.norm(way, axis=0)
        cuts, means = {}, {1: sample.mean(axis=0) if len(sample) else np.zeros(d)}
        nodes = {1: np.arange(len(sample))}
        for level in range(self.depth):
            below = {}
            for node, at in nodes.items():
                p = sample[at] @ way[:, level]
                if len(at) < 4:
                    continue
                c = float(np.median(p))
                if (np.abs(p - c) <= self.spill).mean() > 0.5:
                    c = math.inf  # too dense to part: all stay left
                cuts[node] = c
                for child, take in ((2 * node, at[p <= c]), (2 * node + 1, at[p > c])):
                    if len(take):
                        below[child], means[child] = take, sample[take].mean(axis=0)
            nodes = below
        self.ways.append(way)
        self.cuts.append(cuts)
        self.means.append(means)

    def leaves(self, x: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of each leaf that holds a row of x."""
        way, cuts, means = self.ways[tree], self.cuts[tree], self.means[tree]
        p = x @ way
        row, node, own = np.arange(len(x)), np.ones(len(x), np.int64), np.ones(len(x), np.int64)
        for level in range(self.depth):
            kinds, inv = np.unique(own, return_inverse=True)
            limit = np.array([cuts[k] if k in cuts and k >> level else float(means[k] @ way[:, level]) for k in kinds.tolist()])[inv] if len(kinds) else np.zeros(0)
            q = p[row, level]
            left, right = q <= limit + self.spill, q > limit - self.spill
            row, node, was = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1]), np.concatenate([own[left], own[right]])
            known = np.array([k in means for k in np.unique(node).tolist()], bool)
            own = np.where(known[np.unique(node, return_inverse=True)[1]] if len(node) else np.zeros(0, bool), node, was)
        return row, node


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def packed(column: pa.Array) -> pa.Array:
    """Lists of numbers as the bytes of these numbers, which move through Spark as one value each."""
    flat = np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False))
    size = np.diff(column.offsets.to_numpy())
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32) * flat.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(flat)])


def matrix(column: pa.Array, width: int, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Packed vectors in double precision, padded to one width, and their lengths."""
    values = [np.frombuffer(v.as_buffer(), kind) for v in column]
    size = np.fromiter(map(len, values), np.int64, len(values))
    flat = np.concatenate([*values, np.zeros(0, kind)]).astype(np.float64)
    out = np.zeros((len(size), width))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out, size


def sound(v: Column) -> Column:
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda c: c != 0), F.lit(False))


def shared_before(row: np.ndarray, leaf: np.ndarray, n: int) -> np.ndarray:
    """n x n: whether two rows have one of the leaves given in common."""
    at = np.unique(leaf, return_inverse=True)[1]
    m = np.zeros((n, int(at.max()) + 1 if len(at) else 0), np.float32)
    m[row, at] = 1
    return m @ m.T > 0


def compare(x: np.ndarray, size: np.ndarray, block: np.ndarray, tree: int, leaf: int, forest: Forest, min_cos: float) -> np.ndarray:
    """Which pairs of a leaf's rows are links that count here."""
    norm = np.linalg.norm(x, axis=1)
    u32 = (x / norm[:, None]).astype(np.float32)
    doubt = 1e-6 + 2e-7 * x.shape[1]  # beyond the error of single precision
    link = np.zeros((len(x), len(x)), bool)
    for at in range(0, len(x), 512):
        near = u32[at : at + 512] @ u32.T
        link[at : at + 512] = near >= min_cos + doubt
        i, j = np.nonzero(np.abs(near - min_cos) < doubt)
        for k in range(0, len(i), 100_000):
            p, q = i[k : k + 100_000] + at, j[k : k + 100_000]
            link[p, q] = np.einsum("nd,nd->n", x[p], x[q]) / (norm[p] * norm[q]) >= min_cos
    link |= link.T
    link &= size[:, None] == size[None, :]
    np.fill_diagonal(link, False)
    if len(set(block.tolist())) > 1:
        link &= block[:, None] != block[None, :]
    hit = np.flatnonzero(link.any(axis=1))
    if not len(hit):
        return link
    sub, u = link[np.ix_(hit, hit)], x[hit] / norm[hit, None]
    for t in range(tree):
        sub &= ~shared_before(*forest.leaves(u, t), len(hit))
    row, own = forest.leaves(u, tree)
    earlier = own < leaf
    sub &= ~shared_before(row[earlier], own[earlier], len(hit))
    link[np.ix_(hit, hit)] = sub
    return link


def near_duplicates(vectors: DataFrame, min_cos: float = MIN_COS, trees: int = TREES, leaf: int = LEAF, block: int = BLOCK, sample: int = SAMPLE, spill: float = SPILL, recall: float = RECALL) -> DataFrame:
    """(vec_id, embedding) -> vec_id, n_links, component_id."""
    vectors = vectors.select("vec_id", "embedding")
    kind = np.dtype("float32" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "float64")
    if kind == np.float64:
        vectors = vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))
    good = vectors.where(F.col("vec_id").isNotNull() & sound(F.col("embedding")))
    classes = cut(good.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "vectors")
    count, width = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not count:
        drop_cut(classes)
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    share = max(1, count // sample)
    picked = classes.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(share)) == 0).select("embedding").limit(2 * sample).toArrow()  # about `sample` rows
    start = packed(picked.column("embedding").combine_chunks()) if picked.num_rows else pa.array([], pa.binary())
    forest = Forest(unit(matrix(start, width, kind)[0]), count, min_cos, trees, leaf, spill, recall)
    shared = vectors.sparkSession.sparkContext.broadcast(forest)

    def planted(whole: bool):
        """Where the classes stand: (tree, leaf), and the vectors with it if ``whole``."""
        names = ["tree", "leaf", *(["id", "n", "vector"] if whole else [])]

        def run(batches):
            for batch in batches:
                vector = packed(batch.column("embedding"))
                x = unit(matrix(vector, width, kind)[0])
                for t in range(len(shared.value.ways)):
                    row, at = shared.value.leaves(x, t)
                    more = [c.take(pa.array(row)) for c in (batch.column("id"), batch.column("n"), vector)] if whole else []
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), t, np.int32)), pa.array(at), *more], names=names)

        return classes.select("id", "n", "embedding").mapInArrow(run, "tree int, leaf long" + (", id long, n long, vector binary" if whole else ""))

    hot = cut(planted(False).groupBy("tree", "leaf").count().where(F.col("count") > block).select("tree", "leaf", F.ceil(F.col("count") / block).cast("int").alias("k")), "hot")
    rows = planted(True).join(hot, ["tree", "leaf"], "left").withColumn("b", F.pmod(F.xxhash64("id"), F.coalesce("k", F.lit(1))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1)))
    rows = rows.withColumn("p", F.least("b", "other")).withColumn("q", F.greatest("b", "other")).select("tree", "leaf", "p", "q", "b", "id", "n", "vector")

    def within(group: pa.Table) -> pa.Table:
        x, size = matrix(group.column("vector").combine_chunks(), width, kind)
        ids, n, b = (group.column(c).to_numpy() for c in ("id", "n", "b"))
        first = lambda c: group.column(c)[0].as_py()
        if first("p") != first("q") and len(set(b.tolist())) < 2:
            link = np.zeros((len(x), len(x)), bool)
        else:
            link = compare(x, size, b, first("tree"), first("leaf"), shared.value, min_cos)
        sums = link @ n
        some = np.flatnonzero(sums)
        order = some[np.argsort(ids[some])]
        labels = merge(np.arange(len(order)), *np.nonzero(link[np.ix_(order, order)])) if len(order) else order
        return pa.table({"id": ids[order], "links": pa.array(sums[order].astype(np.int64)), "rep": ids[order][labels] if len(order) else ids[order]})

    found = cut(rows.groupBy("tree", "leaf", "p", "q").applyInArrow(within, "id long, links long, rep long"), "links")
    roots = connected_components(found.select(F.col("id").alias("src"), F.col("rep").alias("dst")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    done = classes.join(links, "id", "left").join(roots, F.col("id") == F.col("node"), "left")
    done = cut(done.select(F.col("embedding").alias("e"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id")), "classes")
    for part in (found, hot, classes):
        drop_cut(part)
    out = vectors.join(done, (F.col("embedding") == F.col("e")) & F.col("vec_id").isNotNull(), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
