import itertools
import zlib

import numpy as np
import pytest

from strandworks.llm import packing as P


def check_plan(plan, counts, cap):
    got = np.zeros(cap + 1, np.int64)
    for pattern, times in plan:
        assert sum(pattern) <= cap and times > 0
        np.add.at(got, list(pattern), times)
    assert got.tolist() == counts.tolist()
    return sum(m for _, m in plan)


def brute(items, cap):
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for b in sorted({*bins}):
            if b + items[i] <= cap:
                rest = list(bins)
                rest.remove(b)
                go(i + 1, [*rest, b + items[i]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_solver_matches_exhaustive_search(seed):
    r = np.random.default_rng(seed)
    cap = int(r.integers(8, 40))
    items = sorted(r.integers(1, cap + 1, r.integers(1, 10)).tolist(), reverse=True)
    counts = np.bincount(items, minlength=cap + 1)
    assert P.lower_bound(counts, cap) <= (want := brute(items, cap))
    assert check_plan(P.solve(counts, cap), counts, cap) == want


def test_search_to_the_end_matches_exhaustive_search():
    items = [19, 19, 20, 22, 22, 28, 31, 32, 32, 36, 40]  # one filling a space, however good, is not enough here
    counts = np.bincount(items, minlength=80)
    assert check_plan(P.solve(counts, 79, None), counts, 79) == 4
    r = np.random.default_rng(5)
    for _ in range(400):
        cap, n = int(r.integers(8, 90)), int(r.integers(1, 13))
        low = int(r.integers(1, max(2, cap // 4)))
        items = sorted(r.integers(low, max(low + 1, cap * 2 // 3), n).tolist(), reverse=True)
        counts = np.bincount(items, minlength=cap + 1)
        assert check_plan(P.solve(counts, cap, None), counts, cap) == brute(items, cap)


def test_every_undominated_filling_is_enumerated():
    def subsets(items, room):
        return {s for k in range(len(items) + 1) for s in itertools.combinations(items, k) if sum(s) <= room}

    def packs(small, large):  # whether the pieces of small fit into pieces of large, as into bins
        if not small:
            return True
        return any(x >= small[0] and packs(small[1:], tuple(sorted([*large[:i], x - small[0], *large[i + 1 :]], reverse=True))) for i, x in enumerate(large) if i == 0 or large[i - 1] != x)

    r = np.random.default_rng(3)
    for _ in range(60):
        room, items = int(r.integers(4, 24)), sorted(r.integers(1, 14, 7).tolist(), reverse=True)
        every = subsets(items, room)
        want = {s for s in every if not any(o != s and packs(s, o) for o in every)}
        counts = np.bincount([*items, 40], minlength=41)
        got = [tuple(sorted(f, reverse=True)) for f, _ in P.undominated(P.Space(counts, 40, room), room) if f is not None]
        assert len(got) == len(set(got)) and set(got) == want


def test_a_long_search_holds_few_tables(monkeypatch):
    """Dropped tables are made again, and the result is that of a search that drops none."""
    r = np.random.default_rng(9)
    counts = np.bincount(r.integers(60, 400, 400), minlength=1001)
    whole = P.solve(counts, 1000, 300)
    monkeypatch.setattr(P, "KEEP", 1)
    assert P.solve(counts, 1000, 300) == whole


def test_solver_beats_best_fit_where_it_is_not_optimal():
    items = [7, 6, 5, 4, 4, 2, 2] * 30  # 30 x (7+... ) sums to 3 full bins of 10
    counts = np.bincount(items, minlength=11)
    assert check_plan(P.solve(counts, 10), counts, 10) <= sum(m for _, m in P.best_fit(counts, 10))


def test_solver_on_many_lengths():
    r = np.random.default_rng(1)
    counts = np.bincount(np.minimum(4096, r.lognormal(6.2, 1.1, 60_000).astype(int) + 1), minlength=4097)
    n = check_plan(P.solve(counts), counts, 4096)
    assert n == P.lower_bound(counts, 4096)


def test_pack_whole(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = [None, "", " \n", "Hello  WORLD it's 42!", "É́ ΣΑΣ x\xa0y\x1cz <|endoftext|>", "word " * 9000, "a" * 20000, "Hello  WORLD it's 42!", "a<|startoftext|>b <|ENDOFTEXT|><|endoftext|>\u0301c<|endoftext|"]
    docs = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)] + [(3, texts[3], 1), (None, "n", 1)], "doc_id long, text string, offset int")
    rows = P.pack(docs, path, keep_ids=True).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for spans in by.values():
        spans.sort()
        assert [a for a, _ in spans] == [0, *itertools.accumulate(n for _, n in spans)][:-1] and sum(n for _, n in spans) <= 4096
    for i, x in enumerate(texts):
        if i != 3:
            got = b"".join(r.ids for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece))
            assert np.frombuffer(got, "<u4").tolist() == [*t.encode(x or "", add_special_tokens=False).ids, 1]
    assert sum(r.doc_id == 3 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    assert P.pack(docs.limit(0), path).count() == 0
