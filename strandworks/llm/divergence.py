"""Divergence of sources: how far the term shares of each (lang, source) group are from its peers' and its language's.

Terms are counted once, in blocks inside tasks and then by Spark. Each lang keeps the terms of at least
``min_docs`` of its rows. A group's share of a term is p = 1 + floor(UNIT * (count + PRIOR) / (N + PRIOR * V)),
in whole numbers: N its count over the V kept terms of its lang.

The comparison is a systolic rotation. The groups of a lang are dealt to cells of about ``cell`` groups, and
the kept terms, in order, to segments of ``segment`` terms. A cell's count vectors of a segment stay in one
partition, kept between rounds; compressed vectors of peers circulate: in round r of C, cell i meets cell
(r - i) mod C, so that each two cells, and each cell with itself, meet exactly once in C rounds. A meeting
works out both directions of all pairs of groups, summed over the segment. Rounds are written one after the
other; a lost executor's resident vectors are made again from their written table. Terms are ranked by a
local heap of ``top`` for each group and segment, merged group by group.

Bounds: a task of a round holds 2 x cell x segment counts, whatever the lang's size; counts are summed in
tasks before they are shuffled; lists sent from tasks are of at most ``segment`` terms.

Rows: a null text, lang or source is an empty one; repeated rows count as rows of their own; other columns,
ids too, aren't used; a group without kept terms has rows of part ``pair`` only; ties go by the item's UTF-8
bytes; no rows give no rows. Counts of a lang may sum to at most 9 * 10**15.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import blocks, cut, drop_cut, run_dir

MIN_DOCS, PRIOR, UNIT, TOP, CELL, SEGMENT = 30, 5, 1_000_000_000, 50, 8, 16_384
#: ASCII letters are lower-cased, all else in ASCII parts terms.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
PIECE = 1 << 20


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces of about a megabyte."""
    text, at = text.translate(FOLD), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and rows of each term, and a row of an empty term for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in blocks(whole, 4_000_000)):
            names: dict[tuple, int] = {}
            group = np.array([names.setdefault(k, len(names)) for k in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())], np.int64)
            held, flat, row, size = [], [], [], []
            for i, text in enumerate(batch.column("text")):
                for words in pieces(text.as_py().encode()):
                    held += words
                    row.append(i)
                    size.append(len(words))
                    if len(held) > 200_000:
                        flat.append(pa.array(held, pa.binary()))
                        held = []
            flat = pa.chunked_array([*flat, pa.array(held, pa.binary())]).combine_chunks().dictionary_encode()
            terms, ids = flat.dictionary, flat.indices.to_numpy().astype(np.int64)
            k = max(1, len(terms))
            each, n = np.unique(np.repeat(np.array(row, np.int64), size) * k + ids, return_counts=True)
            key, at = np.unique(group[each // k] * k + each % k, return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, at, n)
            lang, source = (pa.array([x[i] for x in names], pa.string()) for i in (0, 1))
            own = pa.array(np.concatenate([key // k, np.arange(len(names))]))
            zero = np.zeros(len(names), np.int64)
            term = pa.concat_arrays([terms.take(pa.array(key % k)).cast(pa.string()), pa.array([""] * len(names), pa.string())])
            yield pa.RecordBatch.from_arrays([lang.take(own), source.take(own), term, pa.array(np.concatenate([total, zero])), pa.array(np.concatenate([np.bincount(at, minlength=len(key)).astype(np.int64), zero]))], names=["lang", "source", "term", "n", "docs"])

    filled = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = filled.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def numbered(counts: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, total, id): the kept terms of each lang, numbered from 0 in the order of their bytes."""
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    at = cut(kept.select("lang", "term", "total").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").withColumn("at", F.monotonically_increasing_id()), "terms")
    at = at.withColumn("task", F.shiftright("at", 33))
    runs = at.groupBy("lang", "task").agg(F.count("*").alias("n"), F.min("at").alias("low"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("lang", "task", (before - F.col("low")).alias("shift"))
    return at.join(runs, ["lang", "task"]).select("lang", "term", "total", (F.col("at") + F.col("shift")).alias("id"))


def squeeze(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Places in a segment, ascending, and their counts: steps and the narrowest whole numbers, compressed."""
    kind = np.min_scalar_type(int(counts.max(initial=0)))
    return bytes([kind.itemsize]) + zlib.compress(np.diff(ids, prepend=0).astype("<u4").tobytes() + counts.astype(kind.newbyteorder("<")).tobytes(), 1)


def widen(data: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    if data is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = zlib.decompress(data[1:])
    n = len(raw) // (4 + data[0])
    return np.cumsum(np.frombuffer(raw, "<u4", n).astype(np.int64)), np.frombuffer(raw, f"<u{data[0]}", n, 4 * n).astype(np.int64)


def squeezed(rows: DataFrame, segment: int) -> DataFrame:
    """(lang, source, id, n) -> (lang, source, seg, held, vector)."""
    keyed = rows.select("lang", "source", F.expr(f"id div {segment}").cast("int").alias("seg"), F.struct((F.col("id") % segment).cast("int").alias("at"), "n").alias("x"))
    lists = keyed.groupBy("lang", "source", "seg").agg(F.sum("x.n").alias("held"), F.collect_list("x").alias("xs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = batch.column("xs")[i].values
                at, n = x.field("at").to_numpy(), x.field("n").to_numpy()
                order = np.argsort(at)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in ("lang", "source", "seg", "held")), pa.array([squeeze(at[order], n[order])], pa.binary())], names=["lang", "source", "seg", "held", "vector"])

    return lists.mapInArrow(run, "lang string, source string, seg int, held long, vector binary")


def shares(counts: np.ndarray, held: int, terms: int) -> np.ndarray:
    """1 + floor(UNIT * (count + PRIOR) / (held + PRIOR * terms)), three digits of the unit at a time, so that it stays in 64 bits."""
    whole = held + PRIOR * terms
    if whole >= 9 * 10**15:
        raise OverflowError("more than 9 * 10**15 term occurrences in a lang")
    rest, out = counts + PRIOR, np.zeros(len(counts), np.int64)
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + step
    return out + 1


def table_of(rows: pa.Table, width: int, terms: int) -> np.ndarray:
    """Shares of a cell's groups, a row each, over the terms of a segment."""
    out = np.empty((rows.num_rows, width), np.int64)
    for k, (data, held) in enumerate(zip(rows.column("vector").to_pylist(), rows.column("held").to_pylist())):
        at, n = widen(data)
        counts = np.zeros(width, np.int64)
        counts[at] = n
        out[k] = shares(counts, held, terms) if width else out[k]
    return out


def measured(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, cell: int = CELL, segment: int = SEGMENT) -> DataFrame:
    """docs -> lang, source, part, item, value, rank."""
    spark = docs.sparkSession
    counts = cut(term_counts(docs), "counts")
    terms = cut(numbered(counts, min_docs), "numbered")
    totals = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("all"))
    rows = counts.where("term <> ''").join(terms, ["lang", "term"]).select("lang", "source", "id", "n")
    vectors = cut(squeezed(rows, segment), "vectors")
    overall = squeezed(terms.select("lang", F.lit("").alias("source"), "id", F.col("total").alias("n")), segment).select("lang", "seg", F.col("vector").alias("overall"))
    held = vectors.groupBy("lang", "source").agg(F.sum("held").alias("held"))

    groups = counts.where("term = ''").select("lang", "source")
    cells = groups.groupBy("lang").agg(F.ceil(F.count("*") / F.lit(cell)).cast("int").alias("cells"))
    groups = groups.join(cells, "lang").join(totals, "lang", "left").join(held, ["lang", "source"], "left")
    groups = groups.select(
        "lang", "source", "cells", F.pmod(F.xxhash64("source"), "cells").cast("int").alias("cell"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("terms", "all", "held")),
    )
    # every group of a lang takes part in all of its segments, and in one if the lang keeps no term
    framed = groups.withColumn("seg", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"(terms - 1) div {segment}").cast("int")))))
    framed = cut(framed.join(vectors.drop("held"), ["lang", "source", "seg"], "left").join(overall, ["lang", "seg"], "left"), "frames")
    places = ["lang", "cell", "seg"]
    resident = framed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *places).persist()
    here = lambda t: (int(t.column("terms")[0].as_py()), int(t.column("seg")[0].as_py()))
    width = lambda t: min(segment, here(t)[0] - here(t)[1] * segment)

    def heaps(group: pa.Table) -> pa.Table:
        """Of each group's terms in the segment, those of the largest surplus over the lang."""
        out: list[list] = [[], [], [], []]
        n, seg = here(group)
        if width(group):
            at, all_n = widen(group.column("overall")[0].as_py())
            q = np.zeros(width(group), np.int64)
            q[at] = shares(all_n, group.column("all")[0].as_py(), n)
            for source, data, mine in zip(*(group.column(c).to_pylist() for c in ("source", "vector", "held"))):
                at, counts = widen(data)
                value = shares(counts, mine, n) - q[at] if len(at) else at
                some = np.flatnonzero(value > 0)
                best = some[np.lexsort((at[some], -value[some]))[:top]]
                for k, x in zip(range(4), ([group.column("lang")[0].as_py()] * len(best), [source] * len(best), (at[best] + seg * segment).tolist(), value[best].tolist())):
                    out[k] += x
        return pa.table({"lang": pa.array(out[0], pa.string()), "source": pa.array(out[1], pa.string()), "id": pa.array(out[2], pa.int64()), "value": pa.array(out[3], pa.int64())})

    best = resident.groupBy(*places).applyInArrow(heaps, "lang string, source string, id long, value long")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "id"))).where(F.col("rank") <= top)
    ranked = cut(ranked.join(terms, ["lang", "id"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"), "ranked")

    def meet(own: pa.Table, peers: pa.Table) -> pa.Table:
        """Both directions of the pairs of two cells, or of one cell with itself."""
        out: list[list] = [[], [], []]
        if own.num_rows:
            cells, me, r = (own.column(c)[0].as_py() for c in ("cells", "cell", "round"))
            alone = r < cells and (r - me) % cells == me
            if alone or peers.num_rows:
                a, names = table_of(own, width(own), here(own)[0]), own.column("source").to_pylist()
                b, others = (a, names) if alone else (table_of(peers, width(own), here(own)[0]), peers.column("source").to_pylist())
                for i, name in enumerate(names):
                    first = i + 1 if alone else 0
                    apart = np.abs(b[first:] - a[i]).sum(axis=1).tolist()
                    for other, v in zip(others[first:], apart):
                        for k, x in enumerate(((name, other), (other, name), (v, v))):
                            out[k] += x
        lang = own.column("lang")[0].as_py() if out[0] else ""
        return pa.table({"lang": pa.array([lang] * len(out[0]), pa.string()), "source": pa.array(out[0], pa.string()), "item": pa.array(out[1], pa.string()), "value": pa.array(out[2], pa.int64())})

    rounds = framed.agg(F.max("cells")).first()[0] or 0
    path = f"{run_dir(spark)}/rounds-{counts._strandworks_path.rpartition('-')[2]}"
    found = "lang string, source string, item string, value long"
    for r in range(max(1, rounds)):
        peers = framed.where(F.lit(r) < F.col("cells")).withColumn("to", F.pmod(F.lit(r) - F.col("cell"), F.col("cells"))).where("to < cell")
        peers = peers.select("lang", F.col("to").alias("cell"), "seg", "source", "held", "vector")
        own = resident.select(*places, "source", "cells", "terms", "held", "vector", F.lit(r).alias("round"))
        own.groupBy(*places).cogroup(peers.groupBy(*places)).applyInArrow(meet, found).write.mode("append").parquet(path)
    resident.unpersist()
    pairs = spark.read.schema(found).parquet(path).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    for part in (counts, terms, vectors, framed):
        drop_cut(part)
    return pairs.unionByName(ranked)
