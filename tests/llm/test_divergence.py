import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandworks.llm import divergence as D


def brute(rows, min_docs, top):
    terms = lambda t: [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t or "")]
    count, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        count[lang or "", source or ""].update(terms(text))
        docs[lang or ""].update(set(terms(text)))
    out = []
    share = lambda c, n, v: 1 + D.UNIT * (c + D.PRIOR) // (n + D.PRIOR * v)
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        groups = {s: {t: c[t] for t in kept} for (x, s), c in count.items() if x == lang}
        p = {s: {t: share(c[t], sum(c.values()), len(kept)) for t in kept} for s, c in groups.items()}
        total = {t: sum(c[t] for c in groups.values()) for t in kept}
        q = {t: share(total[t], sum(total.values()), len(kept)) for t in kept}
        for s in groups:
            apart = sorted(((sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "pair", o, v, k + 1) for k, (v, o) in enumerate(apart)]
            more = sorted(((p[s][t] - q[t], t) for t in kept if groups[s][t] and p[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "term", t, v, k + 1) for k, (v, t) in enumerate(more[:top])]
    return sorted(out)


def rows_of(r, sources, n):
    words = ["ab", "Cd", "éa", "Éa", "z", "ß", "w9x", "o'k", "a_b", "中文", "q\x00q", " x", "tail" * 30] + [f"v{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)]
    say = lambda: r.choice([" ", ", ", "\n", "7"]).join(r.choice(words[: r.choice([5, 40, 103])]) for _ in range(r.choice([0, 3, 30])))
    return [(r.choice(["en", "en", "de", None]), f"s{min(int(r.paretovariate(0.6)), sources)}", say()) for _ in range(n)]


@pytest.mark.parametrize("sources,cell,segment,min_docs,top", [(11, 2, 16, 3, 7), (7, 3, 1000, 2, 50), (4, 8, 5, 6, 4), (9, 1, 64, 10_000, 5)])
def test_matches_brute_force(spark, sources, cell, segment, min_docs, top):
    rows = rows_of(random.Random(sources), sources, 400)
    rows += [("en", None, None), ("fr", "only", "a b"), ("", "s1", "ab ab"), ("en", "empty", "1 2 3"), ("en", "long", "Ab " * 700_000 + "z" * 1_500_000)] + [rows[5]] * 3
    df = spark.createDataFrame([(*x, 1, 0.5) for x in rows], "lang string, source string, text string, term int, value double").repartition(6)
    got = sorted(tuple(g) for g in D.measured(df, min_docs, top, cell, segment).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute(rows, min_docs, top)


def test_empty_table_and_lone_groups(spark):
    df = spark.createDataFrame([("en", "s", "a b c")], "lang string, source string, text string")
    assert D.measured(df).count() == 0 and D.measured(df.limit(0)).count() == 0
    two = spark.createDataFrame([("en", "s", "a"), ("en", "t", None)], "lang string, source string, text string")
    assert sorted(tuple(g) for g in D.measured(two).select("source", "part", "item", "value", "rank").collect()) == [("s", "pair", "t", 0, 1), ("t", "pair", "s", 0, 1)]


def test_shares_are_exact():
    r = random.Random(1)
    for _ in range(300):
        terms = r.randint(1, 10**6)
        counts = [r.choice([0, r.randint(0, 9), r.randint(0, 10**14)]) for _ in range(4)]
        held = sum(counts) + r.randint(0, 10**14)
        assert D.shares(np.array(counts), held, terms).tolist() == [1 + 10**9 * (c + 5) // (held + 5 * terms) for c in counts]


def test_squeezed_vectors_come_back():
    r = np.random.default_rng(2)
    for n, high in ((0, 1), (1, 9), (50, 255), (500, 256), (40, 2**40)):
        at = np.sort(r.choice(16_384, n, replace=False)).astype(np.int64)
        counts = r.integers(1, high + 1, n)
        back = D.widen(D.squeeze(at, counts))
        assert back[0].tolist() == at.tolist() and back[1].tolist() == counts.tolist()


def test_each_two_cells_meet_once():
    for c in range(1, 12):
        met = Counter(tuple(sorted((i, (r - i) % c))) for r in range(c) for i in range(c) if (r - i) % c >= i)
        assert set(met.values()) == {1} and len(met) == c * (c + 1) // 2
