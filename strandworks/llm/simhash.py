"""SimHash near-duplicates by a binary trie self-join.

Fingerprints: words are runs of bytes other than ASCII white space, after A-Z are lower-cased; each
run of ``shingle`` words, space-joined, is hashed with XXH64; a fingerprint bit is set if it is set in
over half of the hashes. Distinct fingerprints, not documents, are joined.

Join: node pairs of the trie over the fingerprints are walked together from the root; a pair that
parts at a bit spends one error, and pairs that spend more than ``budget`` are pruned. To spread the
walk over tasks, the pair walk starts below sets of bits on which the two sides agree: the 64 bits are
cut into budget + 1 blocks, any linked pair agrees on a whole block, and again on a block of the bits
left. So a fingerprint goes to (budget + 1)^2 buckets, each a subtree walked by one task. Buckets above
``HOT_ROWS`` are keyed by a further block of their free bits, as often as needed, at most until so few
bits are free that a bucket is small whatever the data hold. No pair is lost on the way and none is
emitted: a task returns one edge for each fingerprint to the representative of its local group.

Rows: null or wordless texts have fingerprint zero and link like any other; texts of fewer words than
a shingle hash their whole word sequence; repeated rows stay; rows of a null id get a fingerprint and
the component of their copies (null if none has an id). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import blocks, connected_components, cut, drop_cut

HOT_ROWS = 4096
#: Rows walked at once, and node pairs of the walk held at once, in a Python worker.
CHUNK_ROWS, CHUNK_PAIRS = 200_000, 400_000


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    from xxhash import xxh64_intdigest as h

    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= shingle:
        hashes = [h(line, seed)]
    else:
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = [h(line[a:b], seed) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    sums = np.zeros(64, np.int64)
    raw = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    for i in range(0, len(raw), 65536):
        sums += np.unpackbits(raw[i : i + 65536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > len(raw), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp), fp being the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in blocks(whole)):
            got = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _blocks(bits: list[int], parts: int) -> list[list[int]]:
    return [x.tolist() for x in np.array_split(np.array(bits), parts)]


def mask_of(path: tuple[int, ...], parts: int) -> int:
    """The bits that a bucket path fixes."""
    free, mask = list(range(64)), 0
    for step in path:
        block = _blocks(free, parts)[step]
        mask |= sum(1 << b for b in block)
        free = [b for b in free if b not in set(block)]
    return mask


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(paths: list[tuple[int, ...]], parts: int):
    """One struct (path, val) for each path."""
    return F.explode(F.array(*[F.struct(F.lit("".join(map(str, p))).alias("path"), F.col("fp").bitwiseAND(F.lit(_signed(mask_of(p, parts)))).alias("val")) for p in paths]))


def bucketed(fps: DataFrame, budget: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(fp, id) -> (path, val, fp, id): every linked pair meets in at least one bucket."""
    parts = budget + 1
    paths = [(a, b) for a in range(parts) for b in range(parts)]
    rows = fps.select("fp", "id", _keys(paths, parts).alias("k")).select("k.path", "k.val", "fp", "id")
    done = None
    for depth in range(2, 4):
        hot = cut(rows.groupBy("path", "val").count().where(F.col("count") > hot_rows).select("path", "val"), "hot")
        if hot.isEmpty():
            drop_cut(hot)
            break
        cold = rows.join(hot, ["path", "val"], "left_anti")
        done = cold if done is None else done.unionByName(cold)
        deeper = [(*p, c) for p in paths for c in range(parts)]
        step = {"".join(map(str, p)): [q for q in deeper if q[:depth] == p] for p in paths}
        pick = F.coalesce(*[F.when(F.col("path") == name, F.array(*[F.struct(F.lit("".join(map(str, q))).alias("path"), F.col("fp").bitwiseAND(F.lit(_signed(mask_of(q, parts)))).alias("val")) for q in qs])) for name, qs in step.items()])
        rows = rows.join(hot, ["path", "val"], "left_semi").select("fp", "id", F.explode(pick).alias("k")).select("k.path", "k.val", "fp", "id")
        paths = deeper
    return rows if done is None else done.unionByName(rows)


def merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest-label union of the links (a, b) into labels, which are roots of themselves."""
    while len(a):
        ra, rb = labels[a], labels[b]
        live = ra != rb
        if not live.any():
            return labels
        a, b, ra, rb = a[live], b[live], ra[live], rb[live]
        np.minimum.at(labels, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels = up
    return labels


def walk(fp: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int | np.ndarray, pairs: int = CHUNK_PAIRS, near: Callable | None = None, labels: np.ndarray | None = None) -> np.ndarray:
    """Labels of the groups that links within ``budget`` bits make in each subtree.

    fp (unsigned) is sorted within each [start, end); label = the position of the group's first row.
    A budget by bit bounds the errors spent from the top bit down to it. ``near(x, y)`` decides on pairs of
    rows in place of the bits of fp. Given ``labels`` hold groups known before: pairs of nodes that lie in
    one of them are not walked.
    """
    allowed = np.broadcast_to(budget, 64)
    near = near or (lambda x, y: np.bitwise_count(fp[x] ^ fp[y]) <= budget)
    runs = None if labels is None else np.concatenate([[0], np.cumsum(labels[1:] != labels[:-1])])
    labels = np.arange(len(fp)) if labels is None else labels
    empty = np.zeros(len(starts), np.int8)
    stack = [(63, starts, ends, starts, ends, empty)]
    ones: dict[int, np.ndarray] = {}
    while stack:
        bit, a0, a1, b0, b1, err = stack.pop()
        if len(a0) > pairs:
            h = len(a0) // 2
            stack += [(bit, a0[h:], a1[h:], b0[h:], b1[h:], err[h:]), (bit, a0[:h], a1[:h], b0[:h], b1[:h], err[:h])]
            continue
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            x, y = a0[leaf], b0[leaf]
            apart = (x != y) & (labels[x] != labels[y])
            x, y = x[apart], y[apart]
            linked = near(x, y)
            labels = merge(labels, x[linked], y[linked])
            a0, a1, b0, b1, err = (z[~leaf] for z in (a0, a1, b0, b1, err))
        if runs is not None and len(a0):
            apart = (runs[a0] != runs[a1 - 1]) | (runs[b0] != runs[b1 - 1]) | (labels[a0] != labels[b0])
            a0, a1, b0, b1, err = (z[apart] for z in (a0, a1, b0, b1, err))
        if bit < 0:  # rows of equal fp, where fp is only a part of what near() compares
            for x, y0, y1 in ((x, y0, y1) for x0, x1, y0, y1 in zip(a0, a1, b0, b1) for x in range(x0, x1)):
                y = y0 + np.flatnonzero(labels[y0:y1] != labels[x])
                y = y[near(np.full(len(y), x), y)]
                labels = merge(labels, np.full(len(y), x), y)
            continue
        if not len(a0):
            continue
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((fp >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        c = ones[bit]
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        same = a0 == b0
        nxt = []
        for x0, x1, y0, y1, cost, use in ((a0, am, b0, bm, 0, None), (am, a1, bm, b1, 0, None), (a0, am, bm, b1, 1, None), (am, a1, b0, bm, 1, ~same)):
            ok = (x1 > x0) & (y1 > y0) & (err + cost <= allowed[bit])
            if use is not None:
                ok &= use
            ok &= ~((x0 == y0) & (x1 - x0 == 1))
            nxt.append((x0[ok], x1[ok], y0[ok], y1[ok], (err[ok] + cost).astype(np.int8)))
        stack.append((bit - 1, *(np.concatenate(z) for z in zip(*nxt))))
    return labels


def whole_buckets(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[pa.Table]:
    """Sorted batches as tables of about CHUNK_ROWS rows that hold whole buckets, a bucket being a run of equal ``names``."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = [batch.column(c) for c in names]
        if n >= CHUNK_ROWS:  # ends at the first change of bucket
            last = [held[-1].column(c)[-1] for c in names]
            at = next((i for i in range(batch.num_rows) if [k[i] for k in key] != last), batch.num_rows)
            if at == batch.num_rows:
                held.append(batch)
                continue
            yield pa.Table.from_batches([*held, batch.slice(0, at)])
            held, n, batch = [], 0, batch.slice(at)
        held.append(batch)
        n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def local_edges(rows: DataFrame, budget: int) -> DataFrame:
    """Bucketed rows -> edges (src, dst) between ids, one for each row that joins a local group."""
    rows = rows.repartition("path", "val").sortWithinPartitions("path", "val")

    def flush(t: pa.Table) -> pa.RecordBatch:
        path = t.column("path").to_pandas().astype("category").cat.codes.to_numpy()
        val, fp, ids = (t.column(n).to_numpy() for n in ("val", "fp", "id"))
        fp = fp.view(np.uint64)
        order = np.lexsort((fp, val, path))
        path, val, fp, ids = path[order], val[order], fp[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (val[1:] != val[:-1])]))
        last = np.concatenate([first[1:], [len(fp)]])
        big = last - first > 1
        labels = walk(fp, first[big], last[big], budget)
        joined = np.flatnonzero(labels != np.arange(len(labels)))
        return pa.RecordBatch.from_arrays([pa.array(ids[joined]), pa.array(ids[labels[joined]])], names=["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_buckets(batches, "path", "val"):
            yield flush(t)

    return rows.mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, budget: int = 2, shingle: int = 3, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp, component_id)."""
    marked = cut(fingerprints(docs, shingle), "fp")
    fps = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("id")), "fps")
    edges = cut(local_edges(bucketed(fps.where("id IS NOT NULL"), budget, hot_rows), budget).distinct(), "edges")
    roots = connected_components(edges)
    classes = cut(fps.join(roots, fps.id == roots.node, "left").select("fp", F.coalesce("root", "id").alias("component_id")), "classes")
    for done in (edges, fps):
        drop_cut(done)
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, budget: int = 2, shingle: int = 3) -> DataFrame:
    """The documents of the smallest id of each component; documents of a null id all stay.

    Rows that repeat an id and its text stay once; other texts of that id stay beside it.
    """
    found = near_duplicates(docs, budget, shingle)
    keep = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.withColumn("_d", F.md5(F.coalesce("text", F.lit("")))).join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id", "_d"]).drop("_d")
    return kept.unionByName(docs.where("doc_id IS NULL"))
