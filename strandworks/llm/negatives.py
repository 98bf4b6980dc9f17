"""Hard negatives by dual-tree search: trees over anchors and over candidates, walked together.

Candidates and anchors are each parted by a tree of hyperplanes that is fitted to a bounded sample (at most
``SAMPLE`` rows) and applied to every row, so that a leaf has about ``BLOCK`` candidates or ``GROUP``
anchors; larger leaves are split by a hash of the id. Within a leaf's block a task builds the rest of the
tree: by label first, then by halves along the line between two far points, down to ``LEAF`` candidates or
``ANCHOR_LEAF`` anchors. Each node has a ball, a centre and a radius, around its rows.

For two balls the inner products lie in <ca, cb> -/+ (|ca| rb + |cb| ra + ra rb). A pair of an anchor node
and a candidate node is dropped when that interval holds nothing that any anchor of the node still wants,
so whole groups of anchors are pruned at once; pairs of leaves are scored exactly. The same interval decides
which leaves of the upper tree a group of anchors visits at all.

1. Positives: a group of anchors first visits the candidates of its nearest leaf; its worst fifth score then
   prunes the other leaves.
2. Negatives: wanted are the first ``depth`` of other labels with 80 x positive <= 100 x score <=
   100 x positive, for each positive; lists that fill up raise the lower end.

Results are exact: what is pruned can't be in a list. Scores are whole numbers; products and sums below
2**53 are worked out in double precision, larger ones in whole numbers. Lists of one anchor from several
blocks are merged by rank. What is broadcast: the upper trees, at most ``TOP_BYTES``.

Rows: a null id, label or vector, or a null or non-finite component take no part, nor do vectors whose
product with one like them might not fit in a long; vectors of other lengths don't meet; rows with the same
id, label and vector count once; other rows of the anchor's id are neither its positives nor its negatives;
a positive score below zero leaves an empty range; ties go to the smaller id; no rows give no rows.
"""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import cut, drop_cut

BLOCK, GROUP, LEAF, ANCHOR_LEAF, SAMPLE, TOP_BYTES = 512, 128, 32, 8, 8192, 32_000_000
FACTOR, ANCHORS, POSITIVES, DEPTH = 256, 100, 5, 5
LOW, WHOLE = 80, 100  # a negative has at least LOW / WHOLE of the positive's score


class Upper:
    """The upper tree: hyperplanes in, the leaf of each row out."""

    def __init__(self, sample: np.ndarray, rows: int, size: int):
        d = max(1, sample.shape[1])
        levels = min(math.ceil(math.log2(max(1, rows) / size)) if rows > size else 0, int(math.log2(max(1, TOP_BYTES // (32 * d)))))
        r = np.random.default_rng(2)
        self.planes: dict[int, tuple[np.ndarray, float]] = {}
        self.centres: dict[int, np.ndarray] = {}
        todo = [(1, np.arange(len(sample)), 0)]
        while todo:
            node, at, level = todo.pop()
            self.centres[node] = sample[at].mean(axis=0) if len(at) else np.zeros(d)
            if level < levels and len(at) > 3 and (way := apart(sample[at], r)) is not None:
                p = sample[at] @ way
                limit = float(np.median(p))
                if (p <= limit).all():
                    limit = float(np.mean(p))
                if (p <= limit).any() and (p > limit).any():
                    self.planes[node] = way, limit
                    todo += [(2 * node, at[p <= limit], level + 1), (2 * node + 1, at[p > limit], level + 1)]

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf and distance to the leaf's centre of each row."""
        leaf = np.ones(len(x), np.int64)
        todo = [(1, np.arange(len(x)))]
        far = np.zeros(len(x))
        while todo:
            node, at = todo.pop()
            if node in self.planes and len(at):
                way, limit = self.planes[node]
                right = x[at] @ way > limit
                todo += [(2 * node, at[~right]), (2 * node + 1, at[right])]
            elif len(at):
                leaf[at] = node
                far[at] = np.linalg.norm(x[at] - self.centres[node], axis=1)
        return leaf, far


def apart(x: np.ndarray, r: np.random.Generator) -> np.ndarray | None:
    """The direction between two far points; none if all are equal."""
    a = x[np.argmax(((x - x[r.integers(len(x))]) ** 2).sum(axis=1))]
    way = x[np.argmax(((x - a) ** 2).sum(axis=1))] - a
    return way / np.linalg.norm(way) if way.any() else None


class Tree:
    """A block's tree: rows in the order of their leaves, and nodes with balls.

    nodes: (start, end, left, right, label), no children for a leaf, no label for a node of several.
    """

    def __init__(self, x: np.ndarray, label: np.ndarray, leaf: int = LEAF):
        r = np.random.default_rng(3)
        self.order = np.lexsort((label,))
        self.nodes: list[list] = []
        f = x.astype(np.float64)
        centres, radii = [], []
        todo = [(0, len(x), -1, 0)]
        while todo:
            start, end, parent, side = todo.pop()
            own = self.order[start:end]
            k = len(self.nodes)
            one = len(own) and bool((label[own] == label[own[0]]).all())
            self.nodes.append([start, end, -1, -1, int(label[own[0]]) if one else None])
            centre = f[own].mean(axis=0)
            centres.append(centre)
            radii.append(float(np.sqrt(((f[own] - centre) ** 2).sum(axis=1).max())))
            if parent >= 0:
                self.nodes[parent][2 + side] = k
            if end - start <= (leaf if one else 1):
                continue
            if not one:  # labels stand in runs: the middle change parts them
                changes = np.flatnonzero(np.diff(label[own])) + 1
                middle = start + int(changes[np.argmin(np.abs(changes - len(own) // 2))])
            else:
                if (way := apart(f[own], r)) is None:
                    continue
                self.order[start:end] = own[np.argsort(f[own] @ way, kind="stable")]
                middle = (start + end) // 2
            todo += [(start, middle, k, 0), (middle, end, k, 1)]
        self.centres, self.radii = np.array(centres), np.array(radii)


def intervals(a: Tree, b: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each two nodes, with room for the errors of double precision."""
    middle = a.centres @ b.centres.T
    na, nb = np.linalg.norm(a.centres, axis=1), np.linalg.norm(b.centres, axis=1)
    reach = na[:, None] * b.radii + a.radii[:, None] * nb + a.radii[:, None] * b.radii
    room = 1e-9 * ((na + a.radii)[:, None] * (nb + b.radii)) + 1e-6
    return middle - reach - room, middle + reach + room


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if most < 2**53 else a @ b.T


class Wanted:
    """What each anchor looks for: lists of (-score, id), each with a range of scores and a length."""

    def __init__(self, ranges: list[list[tuple[int | None, int | None]]], depth: int):
        self.depth = depth
        self.ranges = ranges
        self.lists: list[list[list]] = [[[] for _ in x] for x in ranges]
        none = np.inf
        self.need = np.array([min((-none if lo is None else lo for lo, _ in x), default=none) for x in ranges], np.float64)
        self.cap = np.array([max((none if hi is None else hi for _, hi in x), default=-none) for x in ranges], np.float64)
        self.asked: list[list[float]] = [[-none if lo is None else lo for lo, _ in x] for x in ranges]

    def floor(self, i: int, lows: list[float]) -> None:
        """Scores that other lists already have: nothing below is wanted."""
        self.asked[i] = [max(x, y) for x, y in zip(self.asked[i], lows)]
        self.need[i] = min(self.asked[i], default=np.inf)

    def offer(self, i: int, score: int, row: int) -> None:
        for k, (lo, hi) in enumerate(self.ranges[i]):
            if (lo is None or lo <= score) and (hi is None or score <= hi) and score >= self.asked[i][k]:
                held = self.lists[i][k]
                insort(held, (-score, row))
                if len(held) > self.depth:
                    held.pop()
                if len(held) == self.depth:
                    self.asked[i][k] = max(self.asked[i][k], -held[-1][0])
        self.need[i] = min(self.asked[i], default=np.inf)


def walk(a: Tree, ax: np.ndarray, aid: np.ndarray, b: Tree, bx: np.ndarray, bid: np.ndarray, wanted: Wanted, same: bool) -> int:
    """Offer every row of b that an anchor may want; the number of scores worked out. Rows are in the trees' order."""
    low, high = intervals(a, b)
    todo, scored = [(0, 0)], 0
    while todo:
        i, j = todo.pop()
        s, e, left, right, la = a.nodes[i]
        t, f, down, up, lb = b.nodes[j]
        if la is not None and lb is not None and (la == lb) != same or high[i, j] < wanted.need[s:e].min() or low[i, j] > wanted.cap[s:e].max():
            continue
        if left < 0 and down < 0:
            scores = products(ax[s:e], bx[t:f])
            scored += scores.size
            open_ = (scores >= wanted.need[s:e, None]) & (scores <= wanted.cap[s:e, None]) & (bid[None, t:f] != aid[s:e, None])
            for x, y in zip(*np.nonzero(open_)):
                wanted.offer(s + int(x), int(scores[x, y]), int(bid[t + y]))
        elif down < 0 or left >= 0 and a.radii[i] >= b.radii[j]:
            todo += sorted(((k, j) for k in (left, right)), key=lambda p: high[p])
        else:
            todo += sorted(((i, k) for k in (down, up)), key=lambda p: high[p])
    return scored


def whole(v: Column) -> Column:
    """The components as whole numbers; null where the row takes no part."""
    v = F.transform(v, lambda c: c.cast("double"))
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(v, lambda c: F.floor(c * FACTOR).cast("long"))
    fits = F.forall(v, lambda c: F.abs(c * FACTOR) + 1 < F.sqrt(F.lit(2.0**63) / F.greatest(F.lit(1), F.size(v))))
    return F.when(F.coalesce(finite & fits, F.lit(False)), x)


def rows_of(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def body(ids: np.ndarray, label: np.ndarray, x: np.ndarray) -> bytes:
    """Rows of one width as bytes: components in the narrowest whole numbers."""
    most = int(np.abs(x).max(initial=0))
    kind = next(k for k in ("<i2", "<i4", "<i8") if most <= np.iinfo(k).max)
    return kind[2:].encode() + ids.astype("<i8").tobytes() + label.astype("<i8").tobytes() + x.astype(kind).tobytes()


def unbody(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, label = (np.frombuffer(data, "<i8", n, 1 + k * 8 * n).astype(np.int64) for k in (0, 1))
    return ids, label, np.frombuffer(data, f"<i{chr(data[0])}", -1, 1 + 16 * n).astype(np.int64).reshape(n, -1)


def blocks_of(rows: DataFrame, upper, size: int) -> tuple[DataFrame, dict]:
    """(width, leaf, part, n, body) in the order of each block's tree, and the largest distance to the centre of each (width, leaf)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for width in np.unique(table.column("width").to_numpy()).tolist():
                own = table.filter(pa.compute.equal(table.column("width"), width)).combine_chunks()
                x = rows_of(own.column("x").combine_chunks())
                leaf, far = upper.value[width].leaves(x.astype(np.float64)) if width in upper.value else (np.ones(len(x), np.int64), np.full(len(x), np.inf))
                ids, label = own.column("vec_id").to_numpy(), own.column("label").to_numpy()
                once = np.unique(np.column_stack([ids, label, x]), axis=0, return_index=True)[1]
                data = pa.array([body(ids[k : k + 1], label[k : k + 1], x[k : k + 1]) for k in once], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(once), width, np.int32)), pa.array(leaf[once]), pa.array(ids[once]), pa.array(far[once]), data], names=["width", "leaf", "vec_id", "far", "row"])

    placed = cut(rows.mapInArrow(place, "width int, leaf long, vec_id long, far double, row binary"), "placed")
    leaves = placed.groupBy("width", "leaf").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()  # as many as the upper trees' leaves
    parts = placed.sparkSession.createDataFrame([(g.width, g.leaf, max(1, math.ceil(g.n / size))) for g in leaves] or [(0, 0, 1)], "width int, leaf long, parts int")
    dealt = placed.join(F.broadcast(parts), ["width", "leaf"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int"))

    def build(group: pa.Table) -> pa.Table:
        ids, label, x = (np.concatenate(c) for c in zip(*(unbody(v, 1) for v in group.column("row").to_pylist())))
        once = np.unique(np.column_stack([ids, label, x]), axis=0, return_index=True)[1]
        ids, label, x = ids[once], label[once], x[once]
        order = Tree(x, label).order
        return pa.table({"width": group.column("width").slice(0, 1), "leaf": group.column("leaf").slice(0, 1), "part": group.column("part").slice(0, 1), "n": pa.array([len(ids)], pa.int32()), "body": pa.array([body(ids[order], label[order], x[order])], pa.binary())})

    out = cut(dealt.groupBy("width", "leaf", "part").applyInArrow(build, "width int, leaf long, part int, n int, body binary"), "blocks")
    drop_cut(placed)
    return out, {(g.width, g.leaf): g.far for g in leaves}


def uppers(rows: DataFrame, size: int, sample: int = SAMPLE) -> dict[int, Upper]:
    """An upper tree for each of the commonest widths, at most 16; rows of other widths are a leaf of their own width."""
    counts = rows.groupBy("width").count().orderBy(F.desc("count"), "width").limit(16).collect()
    out = {}
    for g in counts:
        share = max(1, g["count"] // sample)
        picked = rows.where((F.col("width") == g.width) & (F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(share)) == 0)).select("x").limit(sample).toArrow()
        x = rows_of(picked.column("x").combine_chunks()) if picked.num_rows else np.zeros((0, max(1, g.width)))
        out[g.width] = Upper(x.astype(np.float64).reshape(len(x), g.width) if g.width else np.zeros((0, 1)), g["count"], size)
    return out


def visits(anchors: DataFrame, targets: list[tuple[int, int, np.ndarray, float]], parts: int, nearest: bool | None, low: str | None, high: str | None) -> DataFrame:
    """Which candidate leaves each group of anchors visits: its nearest only, all others, or all.

    low, high: columns with the range of scores that the group still wants.
    """
    names = ["width", "group", "n", "body", "ranges"]
    by_width: dict[int, tuple] = {}
    for width in {t[0] for t in targets}:
        own = [t for t in targets if t[0] == width]
        by_width[width] = np.array([t[1] for t in own]), np.array([t[2] for t in own]), np.array([t[3] for t in own])
    shared = anchors.sparkSession.sparkContext.broadcast(by_width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                width = batch.column("width")[k].as_py()
                if width not in shared.value:
                    continue
                leaf, centres, far = shared.value[width]
                _, _, x = unbody(batch.column("body")[k].as_py(), batch.column("n")[k].as_py())
                f = x.astype(np.float64)
                middle = f.mean(axis=0) if width else np.zeros(centres.shape[1])
                radius = float(np.sqrt(((f - middle) ** 2).sum(axis=1).max())) if width else 0.0
                norms, own = np.linalg.norm(centres, axis=1), float(np.linalg.norm(middle))
                score = centres @ middle
                reach = np.where(np.isfinite(far), own * far + norms * radius + radius * far, np.inf)
                room = 1e-9 * (own + radius) * (norms + np.where(np.isfinite(far), far, 0)) + 1e-6
                first = int(np.argmin(((centres - middle) ** 2).sum(axis=1)))
                go = np.ones(len(leaf), bool)
                if nearest is not None:
                    go[:] = not nearest
                    go[first] = nearest
                if low:
                    go &= score + reach + room >= batch.column(low)[k].as_py()
                if high:
                    go &= score - reach - room <= batch.column(high)[k].as_py()
                to = leaf[go]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(np.full(len(to), k))) for c in names), pa.array(to)], names=[*names, "to"])

    kinds = T.StructType([*(anchors.schema[n] for n in names), T.StructField("to", T.LongType())])
    out = anchors.mapInArrow(run, kinds)
    return out.withColumn("bunch", F.pmod(F.xxhash64("group"), F.lit(parts)).cast("int"))


def searched(blocks: DataFrame, visiting: DataFrame, parts: int, same: bool, depth: int) -> DataFrame:
    """(group, at, list, score, id): of each block, the first ``depth`` rows of each list of each anchor, scored exactly."""
    bunches = blocks.select("width", F.col("leaf").alias("to"), "part", "n", "body").withColumn("bunch", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    spread = blocks.select("width", F.col("leaf").alias("to"), (F.col("part") + 0).alias("part"))
    # an anchor group visits all blocks of a leaf; what visits has bodies, grows with groups times leaves and is never broadcast
    going = visiting.join(F.broadcast(spread), ["width", "to"])

    def meet(here: pa.Table, groups: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if here.num_rows and groups.num_rows:
            bid, blabel, bx = unbody(here.column("body")[0].as_py(), here.column("n")[0].as_py())
            b = Tree(bx, blabel)
            bid, bx = bid[b.order], bx[b.order]
            for g in groups.select(["group", "n", "body", "ranges"]).to_pylist():
                aid, alabel, ax = unbody(g["body"], g["n"])
                a = Tree(ax, alabel, ANCHOR_LEAF)
                wanted = Wanted([[(r["low"], r["high"]) for r in g["ranges"][i] or ()] for i in a.order], depth)
                for k, i in enumerate(a.order):
                    wanted.floor(k, [-np.inf if r["floor"] is None else r["floor"] for r in g["ranges"][i] or ()])
                walk(a, ax[a.order], aid[a.order], b, bx, bid, wanted, same)
                for k, i in enumerate(a.order.tolist()):
                    for n, held in enumerate(wanted.lists[k]):
                        for s, row in held:
                            for c, v in zip(out, (g["group"], i, n, -s, row)):
                                c.append(v)
        return pa.table({"group": pa.array(out[0], pa.int64()), "at": pa.array(out[1], pa.int32()), "list": pa.array(out[2], pa.int32()), "score": pa.array(out[3], pa.int64()), "id": pa.array(out[4], pa.int64())})

    keys = ["width", "to", "part", "bunch"]
    return bunches.groupBy(*keys).cogroup(going.groupBy(*keys)).applyInArrow(meet, "group long, at int, list int, score long, id long")


def first(found: DataFrame, depth: int) -> DataFrame:
    order = Window.partitionBy("group", "at", "list").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth)


RANGES = "array<array<struct<low: bigint, high: bigint, floor: bigint>>>"


def hard_negatives(vectors: DataFrame, anchors: int = ANCHORS, positives: int = POSITIVES, depth: int = DEPTH, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(vec_id, embedding, label) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Anchors: ids divisible by ``anchors``."""
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole(F.col("embedding")).alias("x"))
    good = good.where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").withColumn("width", F.size("x"))
    chosen = good.where(F.col("vec_id") % anchors == 0)
    spark = vectors.sparkSession
    trees = uppers(good, block)
    blocks, far = blocks_of(good, spark.sparkContext.broadcast(trees), block)
    own = uppers(chosen, group)
    groups, _ = blocks_of(chosen, spark.sparkContext.broadcast(own), group)
    groups = groups.withColumn("group", F.xxhash64("width", "leaf", "part"))
    targets = [(w, leaf, trees[w].centres[leaf] if w in trees else np.zeros(max(1, w)), r) for (w, leaf), r in far.items()]
    parts = max(1, math.ceil(groups.count() / 64))  # a cell of the search holds about 64 groups of anchors

    top = [F.lit(None).cast("long").alias(n) for n in ("low", "high", "floor")]
    any_score = F.array_repeat(F.array(F.struct(*top)), F.col("n")).cast(RANGES)
    start = groups.withColumn("ranges", any_score)
    seed = cut(first(searched(blocks, visits(start, targets, parts, True, None, None), parts, True, positives), positives), "seed")
    # the fifth score so far: nothing below it can be a positive
    full = seed.where(F.col("rank") == positives).select("group", "at", F.col("score").alias("floor"))
    floors = full.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("at", "floor"))).alias("floors"))
    held = groups.join(floors, "group", "left").withColumn("floors", F.coalesce("floors", F.create_map().cast("map<int,bigint>")))
    each = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.array(F.struct(F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"), F.col("floors")[i].alias("floor"))))
    going = held.withColumn("ranges", each.cast(RANGES)).withColumn("wants", F.when(F.size("floors") < F.col("n"), F.lit(float("-inf"))).otherwise(F.array_min(F.map_values("floors")).cast("double"))).drop("floors")
    more = searched(blocks, visits(going, targets, parts, False, "wants", None), parts, True, positives)
    likes = cut(first(seed.drop("rank").union(more), positives), "positives")

    # one range for each positive; a score below zero leaves none
    low, high = F.expr(f"({LOW} * cast(score AS decimal(20, 0)) + {WHOLE - 1}) div {WHOLE}"), F.col("score")
    ranges = likes.groupBy("group", "at").agg(F.sort_array(F.collect_list(F.struct("rank", F.when(F.col("score") >= 0, low).otherwise(F.lit(1)).alias("low"), F.when(F.col("score") >= 0, high).otherwise(F.lit(0)).alias("high")))).alias("r"))
    ranges = ranges.groupBy("group").agg(
        F.map_from_entries(F.collect_list(F.struct("at", F.transform("r", lambda x: F.struct(x["low"].alias("low"), x["high"].alias("high"), F.lit(None).cast("long").alias("floor")))))).alias("by"),
        F.min(F.array_min(F.transform("r", lambda x: F.when(x["low"] <= x["high"], x["low"])))).cast("double").alias("wants"),
        F.max(F.array_max(F.transform("r", lambda x: F.when(x["low"] <= x["high"], x["high"])))).cast("double").alias("most"),
    )
    asking = groups.join(ranges, "group").where("wants IS NOT NULL")
    asking = asking.withColumn("ranges", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.col("by")[i]).cast(RANGES)).drop("by")
    found = first(searched(blocks, visits(asking, targets, parts, None, "wants", "most"), parts, False, depth), depth)

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in batch.to_pylist():
                ids = unbody(g["body"], g["n"])[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), g["group"])), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)], names=["group", "at", "anchor_id"])

    anchor = groups.select("group", "n", "body").mapInArrow(names, "group long, at int, anchor_id long")
    pairs = likes.select("group", "at", (F.col("rank") - 1).cast("int").alias("list"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = found.select("group", "at", "list", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["group", "at", "list"]).join(anchor, ["group", "at"])
    out = cut(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    for part in (seed, likes, blocks):
        drop_cut(part)
    return out
