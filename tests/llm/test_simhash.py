import numpy as np
import pytest
import xxhash

from strandworks.llm import simhash as S


def brute_fp(text):
    words = bytes(text or "", "utf-8").lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids, budget=2):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= budget:
                root[find(i)] = find(j)
    low = {}
    for i in range(len(fps)):
        low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return [low[find(i)] for i in range(len(fps))]


def test_fingerprint_matches_plain_code():
    for t in (None, "", " \t", "One", "one two", "A b c", "a b c d É\x0bf", "x " * 500, "a\xa0b c d e"):
        assert S.fingerprint(t) == brute_fp(t)


@pytest.mark.parametrize("pairs", [50, 400_000])
def test_walk_matches_all_pairs(pairs):
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << r.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 40).astype(np.uint64)) for _ in range(6)]))
    labels = S.walk(fps, np.array([0]), np.array([len(fps)]), 2, pairs)
    assert labels.tolist() == brute_components(fps.tolist(), list(range(len(fps))))


@pytest.mark.parametrize("hot", [3, 4096])
def test_near_duplicates_match_all_pairs(spark, hot):
    r = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(25):
        t = list(r.choice(words, 150))
        texts.append(" ".join(t))
        for _ in range(4):
            u = list(t)
            u[r.integers(0, 150)] = "changed"
            texts.append(" ".join(u))
    texts += [None, "", "  ", "a", texts[0], texts[0], "long " * 5000]
    rows = [(100 - i, t, "s") for i, t in enumerate(texts)]
    got = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string"), hot_rows=hot).collect()
    fps = [brute_fp(t) for _, t, _ in rows]
    want = dict(zip((i for i, _, _ in rows), brute_components(fps, [i for i, _, _ in rows])))
    assert {g.doc_id: g.component_id for g in got} == want
    assert {g.doc_id: g.fp % 2**64 for g in got} == dict(zip((i for i, _, _ in rows), fps))


def test_empty_and_repeated(spark):
    schema = "doc_id long, text string"
    assert S.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "zz")], schema)
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in S.near_duplicates(rows).collect()) == [(-1, -1), (-1, 1), (1, 1), (1, 1)]
