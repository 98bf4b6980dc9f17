"""Near copies by exact Jaccard similarity of word shingles.

Words are those of simhash.py (A-Z lower-cased, split at ASCII white space); a text is the set of its
runs of ``SHINGLE`` words, hashed with XXH64, or of its whole word sequence if it has fewer. Two texts
link if their sets' Jaccard similarity is ``LEAST`` or more; of each component the smallest id stays.

Texts of the same words are one class first. Candidates come from op4's method, a SimHash and a pair walk
over binary tries with an error budget: a set's fingerprint has ``WORDS`` words of 64 bits, each bit set if
it is set in over half of the hashes, mixed anew for each word. Two sets at J = 0.8 differ in 15.1 % of the
bits (cosine 8/9), too many for one trie, so there are ``TABLES`` of them: table t holds, in buckets that
agree on ``KEY`` bits of its own, one word as a trie (four words, each turned four ways). The walk may spend
``ALLOWED`` errors down to each bit, the mean at J = 0.8 and two standard deviations; rows that meet link if
their first four words differ in at most ``FAR`` of 256 bits. A simulated pair at J = 0.8 is missed with
probability 1e-4, with 4 of 5 shingles in common (18.8 % of the bits) 7e-3; closer pairs are missed less.

Candidates are compared by their whole sets. The texts that walks linked to one representative are compared
with one pivot first, for ``STARS`` pivots in turn. What isn't connected then is joined to groups that share
texts, and all texts of a group are compared with each other by pairs of blocks of ``BLOCK`` texts, as
products of text-by-shingle matrices inside the tasks: no pair is left out, none is emitted, and a task returns one
edge to a representative for each text. A large group of copies costs its size as far as pivots connect it.

Rows: documents of a null id all stay; wordless texts are copies of each other; rows that repeat an id and
its text stay once; where an id has several texts, the one of the smallest digest is compared and the
others all stay, so that no text is lost by its id. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import blocks, connected_components, cut, drop_cut
from .simhash import merge, walk, whole_buckets

SHINGLE, LEAST, STARS, BLOCK = 5, 0.8, 2, 512
#: Ids that are sent to the texts, some 60 to 100 bytes each in an executor; more of them meet the texts in a shuffle.
SENT = 2_000_000
WORDS, KEY, FAR = 16, 12, 68
TABLES = WORDS * (64 // KEY)
_P = float(np.arccos(8 / 9) / np.pi)  # the share of bits that differ at J = 0.8
#: Errors from the top bit down to each bit, bit 0 first.
ALLOWED = np.array([max(1, int(_P * d + 2 * (d * _P * (1 - _P)) ** 0.5)) for d in range(64, 0, -1)], np.int8)
_R = np.random.default_rng(42)
_TIMES, _PLUS, _AGAIN = _R.integers(0, 2**63, (3, WORDS), dtype=np.uint64)
_TIMES, _AGAIN = (x * np.uint64(2) + np.uint64(1) for x in (_TIMES, _AGAIN))


def word_line(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()


def shingles(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes, ascending."""
    from xxhash import xxh64_intdigest as h

    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([h(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.unique(np.array([h(line[a:b], 42) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())], np.uint64))


def simhash(found: np.ndarray) -> np.ndarray:
    """The fingerprint of a set of hashes, WORDS words."""
    sums = np.zeros(WORDS * 64, np.int64)
    for i in range(0, len(found), 255):  # as many bits as a byte can count
        x = found[i : i + 255, None] * _TIMES + _PLUS
        x ^= x >> np.uint64(32)
        x *= _AGAIN
        x ^= x >> np.uint64(29)
        sums += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").view(np.uint64).sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits(2 * sums > len(found), bitorder="little").view("<u8")


def digest() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def marks(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (id, d, same, bits): digests of the text and of its words, and the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in (part for whole in batches for part in blocks(whole)):
            same, bits = [], []
            for t in batch.column("text"):
                words = word_line(t.as_py())
                same.append(xxh3_128_digest(b" ".join(words)))
                bits.append(simhash(shingles(words)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("d"), pa.array(same, pa.binary()), pa.array(bits, pa.binary())], names=["id", "d", "same", "bits"])

    return docs.select("doc_id", "text", digest().alias("d")).mapInArrow(run, "id long, d binary, same binary, bits binary")


def spread(classes: DataFrame) -> DataFrame:
    """(id, bits) -> (key, id, w0 to w3), a row for each table: its bucket, and the first words of the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.arange(TABLES)
        for batch in (whole.slice(i, 2000) for whole in batches for i in range(0, whole.num_rows, 2000)):
            words = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(-1, WORDS)
            keys = (words[:, t % WORDS] >> (KEY * (t // WORDS)).astype(np.uint64)) & np.uint64(2**KEY - 1)
            keys = keys.astype(np.int32) + (t << KEY).astype(np.int32)
            cols = [keys.ravel(), np.repeat(batch.column("id").to_numpy(), TABLES), *(np.repeat(words[:, j].view(np.int64), TABLES) for j in range(4))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "id", "w0", "w1", "w2", "w3"])

    return classes.select("id", "bits").mapInArrow(run, "key int, id long, w0 long, w1 long, w2 long, w3 long")


def met(rows: DataFrame) -> DataFrame:
    """Rows of spread() -> (key, id): ids that the walk of a table links, by the smallest of them, which is there itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_buckets(batches, "key"):
            key, ids = part.column("key").to_numpy(), part.column("id").to_numpy()
            words = np.stack([part.column(f"w{j}").to_numpy().view(np.uint64) for j in range(4)], axis=1)
            t = key >> KEY
            turn = (16 * (t // 4 % 4)).astype(np.uint64)
            trie = words[np.arange(len(key)), t % 4]
            trie = (trie << turn) | (trie >> (np.uint64(64) - turn & np.uint64(63)))
            order = np.lexsort((ids, trie, key))
            key, ids, words, trie = key[order], ids[order], words[order], trie[order]

            def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                return np.bitwise_count(words[x] ^ words[y]).sum(axis=1, dtype=np.int64) <= FAR  # noqa: B023

            labels = np.arange(len(key))
            for step in (1, 2):  # copies stand beside each other: what they make up is one node to the walk
                x = np.flatnonzero(key[step:] == key[:-step])
                linked = near(x, x + step) | (trie[x] == trie[x + step])
                labels = merge(labels, x[linked], x[linked] + step)
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            last = np.concatenate([first[1:], [len(key)]])
            big = last - first > 1
            labels = walk(trie, first[big], last[big], ALLOWED, near=near, labels=labels)
            low = np.full(len(key), np.iinfo(np.int64).max)
            np.minimum.at(low, labels, ids)
            several = np.bincount(labels, minlength=len(key))[labels] > 1
            pairs = np.unique(np.stack([low[labels][several], ids[several]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["key", "id"])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, id long").distinct()


def sets(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (id, found): the shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in blocks(whole)):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([shingles(word_line(t.as_py())).tobytes() for t in batch.column("text")], pa.binary())], names=["id", "found"])

    return docs.select("doc_id", "text").mapInArrow(run, "id long, found binary")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def verified(pairs: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """The pairs (src, dst) whose sets have that similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column("fa"), batch.column("fb")):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (a, b))
                ok.append(min(len(x), len(y)) >= least * max(len(x), len(y)) - 1e-9 and jaccard(x, y) >= least - 1e-12)
            yield batch.select(["src", "dst"]).filter(pa.array(ok, pa.bool_()))

    a, b = (found.select(F.col("id").alias(i), F.col("found").alias(f)) for i, f in (("src", "fa"), ("dst", "fb")))
    return pairs.join(a, "src").join(b, "dst").select("src", "dst", "fa", "fb").mapInArrow(run, "src long, dst long").distinct()


def overlaps(found: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many hashes every two of the sets share; hashes of one set only are left out first."""
    size = np.fromiter(map(len, found), np.int64, len(found))
    _, at, n = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(found)), size)
    shared = n[at] > 1
    row, at = row[shared], np.unique(at[shared], return_inverse=True)[1]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    out = np.zeros((len(found), len(found)), np.float32)
    for start in range(0, int(at[-1]) + 1 if len(at) else 0, columns):
        low, high = np.searchsorted(at, [start, start + columns])
        m = np.zeros((len(found), columns), np.float32)
        m[row[low:high], at[low:high] - start] = 1
        out += m @ m.T
    return out


def within_groups(live: DataFrame, found: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(src, dst): a text and the representative of those it links to, within groups of the rows (key, id)."""
    star = live.select("id", "key").join(live.groupBy("key").agg(F.min("id").alias("low")), "key").select(F.col("id").alias("src"), F.col("low").alias("dst"))
    of = connected_components(star)
    groups = cut(of.select(F.col("node").alias("id"), F.col("root").alias("g")), "groups")
    sizes = groups.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("k"))
    rows = groups.join(sizes, "g").withColumn("b", F.pmod(F.xxhash64("id"), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.select("g", F.least("b", "other").alias("p"), F.greatest("b", "other").alias("q"), "id").join(found, "id")

    def compare(group: pa.Table) -> pa.Table:
        sets_ = [np.frombuffer(v.as_buffer(), np.uint64) for v in group.column("found").combine_chunks()]
        ids, size = group.column("id").to_numpy(), np.array([len(x) for x in sets_], np.float64)
        both = overlaps(sets_)
        near = both >= least * (size[:, None] + size - both) - 1e-6
        labels = merge(np.arange(len(ids)), *np.nonzero(np.triu(near, 1)))
        joined = np.flatnonzero(labels != np.arange(len(ids)))
        return pa.table({"src": ids[joined], "dst": ids[labels[joined]]})

    return rows.groupBy("g", "p", "q").applyInArrow(compare, "src long, dst long")


def links(docs: DataFrame, least: float = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(several, classes, roots): (id, first) of ids with several rows and the digest of the text compared, (id, same) of each class of equal words, and (node, root) of the classes that link to others."""
    found = cut(marks(docs.where("doc_id IS NOT NULL")), "marks")
    several = cut(found.groupBy("id").agg(F.min("d").alias("first"), F.count("*").alias("n")).where("n > 1").select("id", "first"), "several")
    compared = found.join(several.withColumnRenamed("id", "i"), F.col("id") == F.col("i"), "left").where("i IS NULL OR d = first")
    classes = cut(compared.groupBy("same").agg(F.min("id").alias("id"), F.first("bits").alias("bits")), "classes")
    drop_cut(found)
    live = cut(met(spread(classes)), "live")
    linked = cut(live.select(F.col("id").alias("doc_id")).distinct(), "linked")
    found = cut(sets(_compared(docs.join(_sent(linked), "doc_id", "left_semi"), several)), "sets")
    drop_cut(linked)
    edges = cut(live.select(F.col("id").alias("src"), F.col("id").alias("dst")).limit(0), "edges")
    roots = connected_components(edges)
    for turn in range(STARS + 1):
        rooted = live.select("key", "id").join(roots, live.id == roots.node, "left").select("key", "id", F.coalesce("root", "id").alias("root"))
        apart = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
        rest = cut(rooted.join(apart, "key"), "live")
        drop_cut(live)
        live = rest
        if turn < STARS:
            order = F.col("id") if turn == 0 else F.xxhash64("id", F.lit(turn))
            low = live.groupBy("key").agg(F.min(F.struct(order.alias("o"), "id", "root")).alias("p")).select("key", F.col("p.id").alias("b"), F.col("p.root").alias("rb"))
            pairs = live.join(low, "key").where("root <> rb").select(F.least("id", "b").alias("src"), F.greatest("id", "b").alias("dst")).distinct()
            more = verified(pairs, found, least)
        else:
            more = within_groups(live, found, least)
        new = cut(edges.unionByName(more), "edges")
        drop_cut(edges)
        edges, roots = new, connected_components(new)
    for done in (live, found, edges):
        drop_cut(done)
    return several, classes.select("id", "same"), roots


def _sent(ids: DataFrame) -> DataFrame:
    """Ids, from a cut, for a join with texts: broadcast up to a counted limit, so that the texts stay where they are."""
    return F.broadcast(ids) if ids.limit(SENT + 1).count() <= SENT else ids


def _compared(docs: DataFrame, several: DataFrame) -> DataFrame:
    """Rows of ids that stand once, and of others those of the text compared."""
    known = docs.join(_sent(several.select(F.col("id").alias("_id"), F.col("first").alias("_first"))), F.col("doc_id") == F.col("_id"), "left")
    return known.where(F.col("_first").isNull() | (digest() == F.col("_first"))).drop("_id", "_first")


def representatives(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents of the smallest id of each component, once each; documents of a null id all stay."""
    several, classes, roots = links(docs, least)
    heads = classes.join(roots, classes.id == roots.node, "left").where("root IS NULL OR root = id").select(F.col("id").alias("_head"))
    known = docs.where("doc_id IS NOT NULL")
    copies = known.select("doc_id").distinct().join(heads, F.col("doc_id") == F.col("_head"), "left_anti")
    aside = cut(copies.union(several.select("id")).distinct(), "aside")
    once = known.join(_sent(aside), "doc_id", "left_anti")
    several = _sent(several.select(F.col("id").alias("_id"), F.col("first").alias("_first")))
    again = docs.join(several, F.col("doc_id") == F.col("_id")).withColumn("_d", digest()).join(heads, F.col("doc_id") == F.col("_head"), "left")
    again = again.where("_head IS NOT NULL OR _d <> _first").drop("_id", "_first", "_head").dropDuplicates(["doc_id", "_d"]).drop("_d")
    return once.unionByName(again).unionByName(docs.where("doc_id IS NULL"))
