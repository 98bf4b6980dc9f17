import hashlib
import os

import pytest

from strandworks.llm import warc as A

NASTY = [
    None, "", "x", "ends\r\n", "\r\n", "\r\n\r\n", "\r\n\r\n\r\n", "a\r\n\r\nb\r\n\r\nc", "é" * 60, "é" * 60, "\r\r\n\r\n\n", "﻿bom",
    "p" * 99, "p" * 99, "q" * 100, "q" * 100, "q" * 100, "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 5,
    "lead\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 999999\r\n\r\nzz" * 3, "big\r\n\r\nline " * 3000, "long " * 20000,
]


def want(rows):
    first = {}
    for p, _, h in rows:
        if p is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, p), p)
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        r = first.get(h)
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "response" if r is None or r == p else "revisit", None if r == p else r))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", ["128m", "700"])
@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_round_trip(spark, tmp_path, split, broadcast, monkeypatch):
    monkeypatch.setattr(A, "BROADCAST_SPLITS", broadcast)
    monkeypatch.setattr(A.scan, "__defaults__", (broadcast,))
    rows = [(40 - i, None if i % 3 else f"http://h/{i}\r\nX: y", h) for i, h in enumerate(NASTY)] + [(None, "u", "q" * 100), (None, "u", "n" * 200), (3, "u", "long " * 20000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    path = str(tmp_path / "w")
    A.write(pages, path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = sorted((tuple(r) for r in A.digests(spark, path).collect()), key=str)
        bodies = sorted(bytes(r.body) for r in A.read(spark, path).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == want(rows)
    gone = [w[2] for w in want(rows) if w[3] == "revisit"]
    assert len(bodies) == len(rows) and sum(b == b"" for b in bodies) == 2 + len(gone)


def test_files_follow_the_format(spark, tmp_path):
    A.write(spark.createDataFrame([(1, "u", "a\r\nb" * 40)], "page_id long, url string, html string"), str(tmp_path / "w"))
    raw = b"".join((tmp_path / "w" / f).read_bytes() for f in os.listdir(tmp_path / "w") if f.startswith("part"))
    head, body = raw.split(b"\r\n\r\n", 1)
    assert head.startswith(b"WARC/1.1\r\n") and body == b"a\r\nb" * 40 + b"\r\n\r\n" and f"Content-Length: {len(body) - 4}".encode() in head


def test_cut_off_file_and_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a" * 300), (2, "u", "b" * 300)], "page_id long, url string, html string").coalesce(1)
    A.write(pages, str(tmp_path / "w"))
    part = next(tmp_path / "w" / f for f in os.listdir(tmp_path / "w") if f.startswith("part"))
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "part-0.txt").write_bytes(part.read_bytes()[:-100])
    assert [r.page_id for r in A.digests(spark, str(tmp_path / "x")).collect()] == [1]
    A.write(pages.limit(0), str(tmp_path / "e"))
    assert A.digests(spark, str(tmp_path / "e")).count() == 0
