import random

import numpy as np
import public_tokenizers as P

from strandworks.llm import bpe as B

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def test_ids_match_the_tiktoken_library():
    import tiktoken

    c = B.codec(PATH, P.PATTERN)
    exact = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=B.read_ranks(PATH), special_tokens={})
    r = random.Random(1)
    parts = ["a" * 50, "----" * 30, "aaab" * 20, " ", "  \n\n \t", "ñ", "日本語", "🙂👍🏽", "́", "\x1c", "\x85", "\xa0", "'s", "'LL", "=====", "​", "hahahaha", "\U0001fae0", "\U00032642", "ʕ", "\U0001255a", "<|endoftext|>", "x1", "12"]
    texts = ["".join(r.choice(parts)[: r.randint(1, 60)] for _ in range(r.randint(0, 25))) for _ in range(1500)] + ["a" * 30_000, "ab" * 20_000]
    got = c.encode(texts)
    for t, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == exact.encode_ordinary(t)
        assert B.decode_ids(ids, B.token_bytes(PATH)) == t.encode()


def test_small_cache_gives_the_same(monkeypatch):
    texts = [f"some words {i} and {i * 7919} more" for i in range(300)]
    whole = B.Codec(PATH, P.PATTERN).encode(texts)
    monkeypatch.setattr(B, "CACHE_PIECES", 20)
    small = B.Codec(PATH, P.PATTERN)
    assert [small.encode([t])[0] for t in texts] == whole


def test_offsets_cover_characters():
    c = B.codec(PATH, P.PATTERN)
    for t in ("né日🙂 x", "", "🙂" * 5, "plain text"):
        ids = c.encode([t])[0]
        spans = c.offsets(t, ids)
        data = [c.bytes_of[i] for i in np.frombuffer(ids, "<u4")]
        assert all(d in t[a:b].encode() for d, (a, b) in zip(data, spans)) and {i for a, b in spans for i in range(a, b)} == set(range(len(t)))


def test_rows(spark):
    rows = [(1, None, b"x"), (2, "", b"x"), (2, "é🙂", b"x"), (None, "w " * 40_000, b"x"), (2, "é🙂", b"x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids binary")
    enc = B.encode(df, PATH, P.PATTERN, offsets=True)
    got = B.decode(enc, PATH).collect()
    assert [r.doc_id for r in got] == [1, 2, 2, None, 2] and [bytes(r.decoded).decode() for r in got] == [t or "" for _, t, _ in rows]
    assert len(got[2].spans) == len(got[2].ids) // 4 and B.encode(df.limit(0), PATH, P.PATTERN).count() == 0
