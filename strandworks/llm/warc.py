"""WARC archives: writing by Spark's text writer, reading with boundary-chain verification.

Writing: one record a page, its text being header, blank line and payload, and ``\\r\\n\\r\\n`` as the line
separator, which is the end that WARC wants; so files go through Spark's committers to any file system.
Of records with equal payloads of at least ``REVISIT_BYTES`` bytes, that with the smallest page_id is a response;
the others are revisit records without a body that refer to it.

Reading: files are split anywhere. A task reads its split as chunks between ``\\r\\n\\r\\n``; every place in a
chunk where a header with a length begins, within payloads too, is a candidate, and the task emits its
offset, its successor (behind payload and end), and where its chain of successors leaves the split. Sums
of chunk lengths of earlier splits make offsets absolute. Pointer jumping over the splits, from offset 0
of each file, leaves the reachable candidates: one entry for each split. With it each split is walked
again and gives its records; those that run over a split's end come as parts and are put together. A
magic within a payload is on no chain from the start, so it never makes a record.

Rows: null html is an empty payload; null urls have no target header; line breaks in a url are written
as spaces; a null page_id is kept and is never the response of others; repeated rows of the smallest id
are all responses; other columns aren't used; no pages make no records. A file that breaks off within a
record loses that record only.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import cut, drop_cut, run_dir

END = "\r\n\r\n"
REVISIT_BYTES = 100
#: Entries (one a split) up to which they are broadcast; beyond it they are joined by a shuffle.
BROADCAST_SPLITS = 100_000
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
LENGTH = re.compile(rb"^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", re.I | re.M)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))


def write(pages: DataFrame, path: str) -> None:
    """Write a record for each row (page_id, url, html) to WARC files under path."""
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha2("html", 256)).withColumn("bytes", F.octet_length("html").cast("long"))
    narrow = pages.where(F.col("bytes") >= REVISIT_BYTES).select("page_id", "digest")
    firsts = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    firsts = cut(firsts.select(F.col("digest").alias("d"), "first"), "firsts")
    again = narrow.join(firsts, F.col("digest") == F.col("d")).where(~F.col("page_id").eqNullSafe(F.col("first")))
    again = cut(again.select(F.col("page_id").alias("p"), "d", "first").distinct(), "again")  # known in size, so html is shuffled only if it is large
    rows = pages.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    seen = F.col("first").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(seen, "revisit").otherwise("response")),
        line("WARC-Record-ID", _id(F.col("page_id"))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(seen, F.concat(line("WARC-Refers-To", _id(F.col("first"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", F.when(seen, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit("\r\n"),
    )
    rows.select(F.concat(header, F.when(seen, "").otherwise(F.col("html"))).alias("value")).write.option("lineSep", END).text(path)
    drop_cut(again)
    drop_cut(firsts)


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, value): what stands between blank lines, in order within a split."""
    read = spark.read.option("lineSep", END).text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row for each candidate, with offsets from its split's first chunk, and one with the length of each split.

    start, payload, length, next of the candidate; last_*: of the last candidate of its chain in the
    split; exit: where the chain goes on, beyond the split.
    """
    rows = chunks(spark, path).select("file", "split", F.octet_length("value").cast("long").alias("n"), F.when(F.col("value").contains("WARC/1."), F.col("value").cast("binary")).alias("value"))
    names = ["file", "split", "total", "start", "payload", "length", "next", "last_start", "last_payload", "last_length", "exit"]

    def finish(key: tuple, found: list[tuple[int, int, int]], total: int) -> list[tuple]:
        ends: dict[int, tuple] = {}
        out = [(*key, total, *(None,) * 8)]
        for start, payload, length in reversed(found):
            after = payload + length + len(END)
            ends[start] = ends.get(after) or (start, payload, length, after)
            out.append((*key, None, start, payload, length, after, *ends[start]))
        return out

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 0 else pa.int64()) for k, c in enumerate(zip(*rows))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, found, at = None, [], 0
        for batch in batches:
            files, splits, sizes, values = (batch.column(c) for c in ("file", "split", "n", "value"))
            for i, (split, n) in enumerate(zip(splits.to_pylist(), sizes.to_pylist())):
                if key is None or split != key[1] or files[i].as_py() != key[0]:
                    if key is not None:
                        yield batch_of(finish(key, found, at))
                    key, found, at = (files[i].as_py(), split), [], 0
                if values[i].is_valid:
                    v = values[i].as_py()
                    for m in MAGIC.finditer(v):
                        if length := LENGTH.search(v, m.end()):
                            found.append((at + m.start(), at + n + len(END), int(length[1])))
                at += n + len(END)
        if key is not None:
            yield batch_of(finish(key, found, at))

    return rows.mapInArrow(run, "file string, split long, " + ", ".join(f"{n} long" for n in names[2:]))


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, base, entry, carried_start, carried_payload, carried_length), a row a split.

    entry: the first reachable record that begins in the split; carried: the record that runs into it.
    """
    found = cut(candidates(spark, path), "candidates")
    order = W.partitionBy("file").orderBy("split")
    totals = found.where("total IS NOT NULL").select("file", "split", "total")
    splits = cut(totals.withColumn("base", F.sum("total").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("total")), "splits")
    placed = found.where("total IS NULL").join(splits.select("file", "split", "base"), ["file", "split"])
    shift = lambda *names: [(F.col(n) + F.col("base")).alias(n) for n in names]
    placed = cut(placed.select("file", "split", *shift("start", "exit", "last_start", "last_payload"), "last_length"), "placed")
    most = splits.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    jump = placed.select("file", "start", "exit")  # small as Parquet, large in memory: its joins are kept from broadcasting it
    reached = splits.select("file").distinct().select("file", F.lit(0).cast("long").alias("start"))
    for _ in range(max(0, int(most) - 1).bit_length()):  # a chain enters a split at most once
        step = reached.join(jump.hint("merge"), ["file", "start"]).select("file", F.col("exit").alias("start"))
        before, reached = reached, cut(reached.union(step).distinct(), "reached")
        drop_cut(before)
        far = jump.select("file", F.col("start").alias("exit"), F.col("exit").alias("far"))
        before, jump = jump, cut(jump.join(far.hint("merge"), ["file", "exit"]).select("file", "start", F.col("far").alias("exit")), "jump")
        drop_cut(before)
    entry = placed.join(reached, ["file", "start"], "left_semi")
    rows = splits.join(entry.drop("base", "exit"), ["file", "split"], "left")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    carried = [F.last(f"last_{n}", ignorenulls=True).over(earlier).alias(f"carried_{n}") for n in ("start", "payload", "length")]
    out = cut(rows.select("file", "split", "base", F.col("start").alias("entry"), *carried), "entries")
    for done in (found, splits, placed, jump, reached):
        drop_cut(done)
    return out


def scan(spark: SparkSession, path: str, broadcast_splits: int = BROADCAST_SPLITS) -> DataFrame:
    """(file, start, header, at, body, whole): records, or parts of those that run over a split's end.

    header stands with the part that begins the record; at is the part's offset in the payload.
    """
    known = entries(spark, path)
    rows = chunks(spark, path).select("file", "split", F.col("value").cast("binary").alias("value"))
    if known.count() <= broadcast_splits:
        rows = rows.join(F.broadcast(known), ["file", "split"])
    else:
        rows = rows.withColumn("i", F.monotonically_increasing_id()).join(known, ["file", "split"]).repartition("file", "split").sortWithinPartitions("file", "split", "i").drop("i")
    names = ["file", "start", "header", "at", "body", "length"]
    fields = ("base", "entry", "carried_start", "carried_payload", "carried_length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, nxt = None, 0, None
        record, parts = None, []  # (start, header or None, payload, length), bytes so far
        out: list[tuple] = []
        held = 0

        def flush() -> None:
            nonlocal record, held
            if record:
                body = b"".join(parts)
                first = parts_at
                body = body[: record[3] - first]
                if record[1] is not None or body:
                    out.append((key[0], record[0], record[1], first, body, record[3]))
                    held += len(body)
            record = None
            parts.clear()

        def batch_out() -> pa.RecordBatch:
            nonlocal held
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64())
            b = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
            out.clear()
            held = 0
            return b

        parts_at = 0
        for batch in batches:
            splits, files, values = (batch.column(c) for c in ("split", "file", "value"))
            for i, split in enumerate(splits.to_pylist()):
                if key is None or split != key[1] or files[i].as_py() != key[0]:
                    flush()
                    key = (files[i].as_py(), split)
                    at, nxt, c_start, c_payload, c_length = (batch.column(f)[i].as_py() for f in fields)
                    if c_start is not None and at < c_payload + c_length:
                        record, parts_at = (c_start, None, c_payload, c_length), max(0, at - c_payload)
                        if at < c_payload:  # its payload begins within this split
                            parts_at = 0
                v = values[i].as_py()
                if record and at >= record[2] and at < record[2] + record[3]:
                    parts.append(v + END.encode())
                at_end = at + len(v)
                if nxt is not None and at <= nxt < at_end:
                    flush()
                    head = v[nxt - at :]
                    length = int(LENGTH.search(head)[1])
                    record, parts_at = (nxt, head.decode("utf-8", "replace"), at_end + len(END), length), 0
                    nxt = at_end + len(END) + length + len(END)
                at = at_end + len(END)
                if record and at >= record[2] + record[3]:
                    flush()
                if held > 4_000_000:
                    yield batch_out()
        flush()
        if out:
            yield batch_out()

    got = rows.mapInArrow(run, "file string, start long, header string, at long, body binary, length long")
    return got.withColumn("whole", F.col("header").isNotNull() & (F.octet_length("body") == F.col("length")))


def join_parts(parts: DataFrame) -> DataFrame:
    """Records from their parts; those whose bytes aren't all there are left out."""
    whole = parts.groupBy("file", "start").agg(F.max("header").alias("header"), F.max("length").alias("length"), F.array_sort(F.collect_list(F.struct("at", "body"))).alias("p"))
    body = F.aggregate("p", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["body"]))
    return whole.select("file", "start", "header", body.alias("body"), "length").where(F.col("header").isNotNull() & (F.octet_length("body") == F.col("length"))).drop("length")


def field(name: str) -> Column:
    """A header's value; null without it."""
    got = F.regexp_extract("header", rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)
    return F.when(got != "", got)


def page_of(value: Column) -> Column:
    return F.regexp_extract(value, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, header, body) of every record; the archive is scanned twice, as whole records and as parts."""
    rows = scan(spark, path)
    return rows.where("whole").select("file", "start", "header", "body").unionByName(join_parts(rows.where("NOT whole")))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record; one scan, no payload is kept."""
    sha = F.sha2("body", 256)
    rows = scan(spark, path).select("file", "start", "header", "at", "length", "whole", F.when(F.col("whole"), sha).alias("sha"), F.when(~F.col("whole"), F.col("body")).alias("body"))
    rows = cut(rows, "records")
    parts = join_parts(rows.where("NOT whole")).select("header", F.octet_length("body").cast("long").alias("length"), F.sha2("body", 256).alias("sha"))
    records = rows.where("whole").select("header", "length", "sha").unionByName(parts)
    records = records.select(page_of(field("WARC-Record-ID")).alias("page_id"), F.lower(field("WARC-Type")).alias("record_type"), page_of(field("WARC-Refers-To")).alias("refers_to"), F.regexp_extract(field("WARC-Payload-Digest"), "sha256:([0-9a-f]{64})", 1).alias("said"), "length", "sha")
    full = records.where("record_type = 'response'")
    known = full.select(F.col("page_id").alias("p"), F.col("sha").alias("s"), F.col("length").alias("n")).where("p IS NOT NULL").dropDuplicates(["p", "s"])
    known = cut(known, "responses")
    back = records.where("record_type = 'revisit'").join(known, (F.col("refers_to") == F.col("p")) & (F.col("said") == F.col("s")))
    return full.select("page_id", F.col("length").alias("payload_bytes"), F.col("sha").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(
        back.select("page_id", F.col("n").alias("payload_bytes"), F.col("s").alias("payload_digest"), "record_type", "refers_to")
    )


def new_path(spark: SparkSession) -> str:
    return f"{run_dir(spark)}/warc-{uuid.uuid4().hex}"
