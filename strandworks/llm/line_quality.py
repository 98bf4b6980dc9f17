"""Quality rules: per-document base rules and cross-document line frequency.

Lines (``\\n``-split, with a word) are normalised (A-Z lower-cased, digits made 0, white space made one
space, trimmed) and hashed. For each host the distinct documents (ids) of a line are counted. A line in
more than ``min_docs`` documents of a host is boilerplate, at any size of the host. Boilerplate is
removed from every document of that host but the one with the smallest id that holds it, so that a
text that was copied often keeps one whole bearer. A document with fewer than ``min_words`` words left,
or fewer than ``min_left`` of its words, is depleted and rejected; so is one that fails a base rule.

A host with D documents of m lines on average has at most m D / min_docs boilerplate lines; their set is
broadcast when at most ``BROADCAST_LINES``, a counted bound, and joined by a shuffle beyond it.

Rows: null text has no words and fails; null host is a host of its own; rows of a null id count as one
document and never as first holder; rows that repeat an id count as one document; an empty table gives no
rows. Input columns other than doc_id, text and the host column aren't returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import blocks, carried, cut

MIN_DOCS, MIN_WORDS, MIN_LEFT = 20, 20, 0.3
BROADCAST_LINES = 100_000
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"abcdefghijklmnopqrstuvwxyz000000000")


def line_hash(line: str) -> int | None:
    """Signed hash of the normalised line; none without a word."""
    from xxhash import xxh64_intdigest

    words = line.encode("utf-8").translate(FOLD).split()
    if not words:
        return None
    h = xxh64_intdigest(b" ".join(words), 0)
    return h - (1 << 64) if h >> 63 else h


def repeats(word_lists: list[list[bytes]], width: int = 8) -> np.ndarray:
    """For each list, its words that lie in a window of ``width`` words found twice or more in the list.

    Windows get exact ids by doubling: ids of spans of 2, 4, 8 words from pairs of ids of half as many.
    """
    sizes = np.array([len(w) for w in word_lists], np.int64)
    out = np.zeros(len(sizes), np.int64)
    if sizes.sum() == 0:
        return out
    names: dict = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for ws in word_lists for w in ws), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    span = 1
    while span < width:
        ids = np.unique(ids, return_inverse=True)[1]
        nxt = np.full(len(ids), -1, np.int64)
        nxt[: max(0, len(ids) - span)] = ids[span:]
        ids = ids * (ids.max() + 2) + nxt + 1
        span *= 2
    starts = np.flatnonzero(at + width <= sizes[doc])
    if not len(starts):
        return out
    ids = np.unique(ids[starts], return_inverse=True)[1]
    key = np.unique(doc[starts] * (ids.max() + 1) + ids, return_inverse=True, return_counts=True)
    twice = starts[key[2][key[1]] > 1]
    cover = np.zeros(len(doc) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + width, -1)
    np.add.at(out, doc[np.cumsum(cover)[:-1] > 0], 1)
    return out


def host_lines(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row (host, line, doc_id) for each distinct normalised line of a document."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("host", T.StringType()), T.StructField("line", T.LongType()), T.StructField("doc_id", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in blocks(whole)):
            found = [np.fromiter({h for line in (t.as_py() or "").split("\n") if (h := line_hash(line)) is not None}, np.int64) for t in batch.column("text")]
            row = np.repeat(np.arange(batch.num_rows), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("host").take(pa.array(row)), pa.array(np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64)), batch.column("doc_id").take(pa.array(row))],
                names=["host", "line", "doc_id"],
            )

    return docs.select(F.col(host).cast("string").alias("host"), "doc_id", "text").mapInArrow(run, schema)


def common_lines(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS) -> DataFrame:
    """(host, line, first_id): the lines in more than ``min_docs`` distinct documents of a host."""
    counts = host_lines(docs, host).groupBy("host", "line").agg(
        (F.countDistinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))).alias("docs"), F.min("doc_id").alias("first_id")
    )
    return counts.where(F.col("docs") > min_docs).select("host", "line", "first_id")


def found_lines(docs: DataFrame, host: str, common: DataFrame) -> DataFrame:
    """(h, d, found): the common lines of each document, joined by a shuffle on (host, line)."""
    c = common.select(F.col("host").alias("h"), F.col("line").alias("l"), "first_id")
    lines = host_lines(docs, host)
    hit = lines.join(c, (lines.line == c.l) & lines.host.eqNullSafe(c.h))
    return hit.groupBy(F.col("host").alias("h"), F.col("doc_id").alias("d")).agg(F.collect_set(F.struct("line", "first_id")).alias("found"))


def judge(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, min_words: int = MIN_WORDS, min_left: float = MIN_LEFT, broadcast_lines: int = BROADCAST_LINES, carry: list[str] | None = None) -> DataFrame:
    """docs -> doc_id, the base counts, base_failed, kept, n_removed_lines, n_words_left, cleaned text, row of carried columns."""
    extra, extra_schema = carried(docs, carry)
    more = bool(extra)
    common = cut(common_lines(docs, host, min_docs), "lines")
    rows = docs.select("doc_id", "text", F.col(host).cast("string").alias("host"), *extra)
    look = None
    if common.limit(broadcast_lines + 1).count() <= broadcast_lines:
        got = common.toPandas()
        look = {}
        for h, line, first in zip(got["host"], got["line"], got["first_id"].astype(object)):
            look.setdefault(h if isinstance(h, str) else None, {})[int(line)] = None if first is None or first != first else int(first)
        look = docs.sparkSession.sparkContext.broadcast(look)
    else:
        found = found_lines(docs, host, common)
        rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("host").eqNullSafe(F.col("h")), "left").drop("h", "d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in blocks(whole)):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = batch.column("doc_id").to_pylist()
            drops = [look.value.get(h, {}) for h in batch.column("host").to_pylist()] if look else [{x["line"]: x["first_id"] for x in f or ()} for f in batch.column("found").to_pylist()]
            words = [t.encode("utf-8").split() for t in texts]
            again = repeats(words)
            cols: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "n_words_left", "cleaned")}
            for doc, text, ws, rep, drop in zip(ids, texts, words, again.tolist(), drops):
                lines = text.split("\n")
                full = [x for x in lines if x.strip(SPACES)]
                gone = {i for i, x in enumerate(lines) if drop and (h := line_hash(x)) in drop and (doc is None or drop[h] != doc)} if drop else set()
                left = len(ws) - sum(len(lines[i].encode("utf-8").split()) for i in gone)
                failed = len(ws) < min_words or 100 * rep > 30 * len(ws)
                for k, v in (
                    ("n_words", len(ws)),
                    ("word_chars", len(text) - sum(map(text.count, SPACES))),
                    ("n_symbols", sum(map(text.count, SYMBOLS))),
                    ("n_dup_lines", len(full) - len(set(full))),
                    ("n_repeat_words", rep),
                    ("base_failed", failed),
                    ("kept", not failed and left >= min_words and left >= min_left * len(ws)),
                    ("n_removed_lines", len(gone)),
                    ("n_words_left", left),
                    ("cleaned", "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text),
                ):
                    cols[k].append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, pa.bool_() if k in ("base_failed", "kept") else pa.string() if k == "cleaned" else pa.int64()) for k, v in cols.items()), *([batch.column("row")] if more else [])], names=["doc_id", *cols, *(["row"] if more else [])])

    return rows.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_removed_lines long, n_words_left long, cleaned string" + extra_schema)
