"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

Ranks of a public tiktoken file become a tokenizers BPE model over the byte-to-character alphabet:
each token's bytes are written in stand-in characters, and each token has one merge, ordered by its
rank. Texts are cut by the pattern; the distinct pieces of an Arrow batch go through the library once,
and texts take their ids from a bounded piece cache. Offsets come back as character spans: a
byte-to-character map of the text widens a token that holds part of a character to the whole character.
Decoding joins the tokens' bytes over the whole id list before any UTF-8 is read, so characters split
over tokens come back whole.

One merge a token is enough for the ids of the ranks themselves (lowest rank first, then leftmost). Until
a merge crosses its ends, a stretch of bytes merges within a text as it does alone; once one has, no
token spans just that stretch. So a token is only ever made of the two parts that are left before the
last merge of its own bytes (``last_parts``), and with one pair a rank the library's order is that order.
A token whose bytes alone don't merge into it has no merge and stands for whole pieces only.

The pattern is run by the regex library, whose Unicode version differs from that of the Rust engine. A
text with a character that the two class differently is cut in a copy where such a character is replaced
by one of the Rust engine's class; the pieces, and so the ids, are those of the text.

Rows: null text is empty, with no ids; repeated rows stay; other columns pass through untouched.
"""

from __future__ import annotations

import base64
import math
import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .common import blocks

#: Bounds of the piece cache of a Python worker: entries, and characters of a piece that is kept.
CACHE_PIECES, CACHE_CHARS = 120_000, 64
#: Finds characters outside the blocks (Latin, Greek, Cyrillic) whose classes all Unicode versions share.
BEYOND = re.compile("[^\x00-\u024f\u0370-\u0377\u0391-\u03a1\u03a3-\u0481\u2010-\u2027\u2030-\u205e]").search


def byte_alphabet() -> dict[int, str]:
    """Byte -> stand-in character: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """Id -> bytes: each token's stand-in characters, as the vocabulary writes them, through the reversed byte table."""
    back = {c: b for b, c in byte_alphabet().items()}
    stand = byte_alphabet()
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = bytes(back[c] for c in (stand[b] for b in token))
    return out


def last_parts(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that merging the token's bytes, lowest rank first and leftmost, leaves before the last merge."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min(((ranks.get(a + b, math.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
        if best[0] == math.inf:
            return None
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


class Codec:
    """Encoder of one vocabulary; one per Python worker."""

    #: A character of each class of the pattern: letter, number, white space, the rest.
    STAND = ("\u02bb", "\u00b2", "\u2003", "\u00a7")

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        import regex
        import tiktoken
        from tokenizers import Tokenizer, models

        ranks = read_ranks(path)
        self.table = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})
        self.bytes_of = token_bytes(path)
        wide = {token: token.decode("latin-1").translate(self.table) for token in ranks}
        merges = [(wide[p[0]], wide[p[1]]) for token in sorted(ranks, key=ranks.get) if (p := last_parts(token, ranks))]
        self.model = Tokenizer(models.BPE(vocab={wide[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.cut = regex.compile(pattern)
        self.cache: dict[str, bytes] = {}
        single = {bytes([i]): i for i in range(256)}  # tells whether the Rust engine puts a character into a class; gives no ids
        self.classes = [(regex.compile(p).fullmatch, tiktoken.Encoding(p, pat_str=p, mergeable_ranks=single, special_tokens={})) for p in (r"\p{L}", r"\p{N}", r"\s")]
        self.stand: dict[str, str] = {}

    def stand_in(self, c: str) -> str:
        """The character itself, or one of its Rust class where the engines class it differently."""
        got = self.stand.get(c)
        if got is None:
            there = [bool(rust.encode_ordinary(c)) for _, rust in self.classes]
            same = [bool(here(c)) for here, _ in self.classes] == there
            got = self.stand[c] = c if same else next((s for s, t in zip(self.STAND, there) if t), self.STAND[3])
        return got

    def pieces(self, text: str) -> list[str]:
        if BEYOND(text) and any(self.stand_in(c) != c for c in set(text)):
            return [text[m.start() : m.end()] for m in self.cut.finditer("".join(map(self.stand_in, text)))]
        return self.cut.findall(text)

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of new pieces, as little-endian unsigned 32-bit integers."""
        order = sorted(pieces)
        got = {}
        for i in range(0, len(order), 4_000):
            part = order[i : i + 4_000]
            wide = [p.encode("utf-8").decode("latin-1").translate(self.table) for p in part]
            got |= {p: struct.pack(f"<{len(e.ids)}I", *e.ids) for p, e in zip(part, self.model.encode_batch_fast(wide, add_special_tokens=False))}
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.pieces(t) for t in texts]
        new = {p for p in set().union(*cut) if p not in self.cache}
        if len(self.cache) + len(new) > CACHE_PIECES:
            self.cache.clear()
            new = set().union(*cut)
        self.cache.update(self.learn(new))
        out = [b"".join(map(self.cache.__getitem__, pieces)) for pieces in cut]
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        for p in [p for p in new if len(p) > CACHE_CHARS]:
            self.cache.pop(p, None)
        return out

    def offsets(self, text: str, ids: bytes) -> list[tuple[int, int]]:
        """Character span of each token; one that holds part of a character spans all of it."""
        width = np.frombuffer(text.encode("utf-8"), np.uint8)
        char_of = np.cumsum((width & 0xC0) != 0x80) - 1
        ends = np.cumsum([len(self.bytes_of[i]) for i in np.frombuffer(ids, "<u4")], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        return [(int(char_of[a]), int(char_of[b - 1]) + 1) for a, b in zip(starts, ends)]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, offsets: bool = False) -> DataFrame:
    """Add ``ids`` (binary: little-endian unsigned 32-bit) and, if asked for, ``spans`` to a frame with ``text``."""
    schema = T.StructType([*(f for f in df.schema if f.name not in ("ids", "spans")), T.StructField("ids", T.BinaryType())])
    if offsets:
        schema.add("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
    keep = [f.name for f in df.schema if f.name not in ("ids", "spans")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for part in blocks(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = c.encode(texts)
                cols = [part.column(n) for n in keep] + [pa.array(ids, pa.binary())]
                names = [*keep, "ids"]
                if offsets:
                    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                    cols.append(pa.array([[{"start": a, "end": b} for a, b in c.offsets(t, i)] for t, i in zip(texts, ids)], kind))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.mapInArrow(run, schema)


def decode_ids(ids: bytes, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decode(df: DataFrame, path: str) -> DataFrame:
    """Add ``decoded`` (binary: the bytes) to a frame with ``ids``; null ids decode to no bytes."""
    keep = [f.name for f in df.schema if f.name != "decoded"]
    schema = T.StructType([*(f for f in df.schema if f.name != "decoded"), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for batch in (part for whole in batches for part in blocks(whole, column="ids")):
            got = [decode_ids(i.as_py() or b"", table) for i in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(got, pa.binary())], names=[*keep, "decoded"])

    return df.mapInArrow(run, schema)
