import random

from strandworks.llm import line_quality as L


def brute_repeats(words, width=8):
    spans = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
    return len({j for i, s in enumerate(spans) if spans.count(s) > 1 for j in range(i, i + width)})


def test_repeats_match_brute_force():
    r = random.Random(2)
    lists = [[r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(0, 60))] for _ in range(80)] + [[b"x"] * 20, [], [b"q"] * 8, [b"q"] * 9]
    assert L.repeats(lists).tolist() == [brute_repeats(w) for w in lists]
    assert L.repeats([[]]).tolist() == [0]
    for n in range(10):
        for words in ([b"w"] * n, [b"%d" % i for i in range(n)]):
            assert L.repeats([words]).tolist() == [brute_repeats(words)]
            assert L.repeats([[], words, []]).tolist() == [0, brute_repeats(words), 0]


def brute(rows, min_docs):
    docs = [(d, t or "", h) for d, t, h in rows]
    holders, first = {}, {}
    for d, t, h in docs:
        for k in {L.line_hash(x) for x in t.split("\n")} - {None}:
            holders.setdefault((h, k), set()).add(d)
            if d is not None:
                first[h, k] = min(first.get((h, k), d), d)
    out = []
    for d, t, h in docs:
        left = [x for x in t.split("\n") if (k := L.line_hash(x)) is None or len(holders[h, k]) <= min_docs or d is not None and first.get((h, k)) == d]
        n, m = len(t.encode().split()), len("\n".join(left).encode().split())
        failed = n < L.MIN_WORDS or 100 * brute_repeats(t.encode().split()) > 30 * n
        out.append((str(d), failed, not failed and m >= L.MIN_WORDS and m >= L.MIN_LEFT * n, "\n".join(left)))
    return sorted(out)


def test_judge_matches_brute_force_both_ways(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    common = [" ".join(word() for _ in range(5)) for _ in range(4)]
    rows = []
    for i in range(60):
        lines = [" ".join(word() for _ in range(12)) for _ in range(r.randint(1, 4))] + r.sample(common, r.randint(0, 4)) + ["", "  "]
        r.shuffle(lines)
        rows.append((i, "\n".join(lines), r.choice(["h1", "h1", "h2", None])))
    rows += [(100, None, "h1"), (101, "", None), (102, "\n".join(common), "h1"), (None, "\n".join(common * 3), "h1"), (7, rows[7][1], rows[7][2]), (104, "w" * 50_000, "h2"), (105, common[0].upper() + "\n" + "v " * 5, "h1")]
    df = spark.createDataFrame([(*x, True) for x in rows], "doc_id long, text string, source string, kept boolean")
    want = brute(rows, 3)
    for limit in (L.BROADCAST_LINES, 0):
        got = L.judge(df, min_docs=3, broadcast_lines=limit).collect()
        assert len(got) == len(rows)
        assert sorted((str(g.doc_id), g.base_failed, g.kept, g.cleaned) for g in got) == want
    assert L.judge(df.limit(0)).count() == 0


def test_a_copied_text_keeps_one_whole_bearer(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    text = "\n".join(" ".join(word() for _ in range(9)) for _ in range(6))
    rows = [(i, text, "h") for i in range(40)] + [(100 + i, " ".join(word() for _ in range(30)), "h") for i in range(40)]
    got = {g.doc_id: g.kept for g in L.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0] and not any(got[i] for i in range(1, 40)) and all(got[100 + i] for i in range(40))


def test_a_line_in_a_small_share_of_a_large_host(spark):
    import corpus_pipeline as C

    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    line, rare = (" ".join(word() for _ in range(8)) for _ in range(2))
    body = lambda i: " ".join(word() for _ in range(30)) + (f"\n{line}" if i < 30 else "") + (f"\n{rare}" if 100 <= i < 120 else "")
    rows = [(i, body(i), "en", "large", 1) for i in range(2000)] + [(5000, " ".join(word() for _ in range(15)) + "\n" + line, "en", "large", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for limit in (L.BROADCAST_LINES, 0):
        judged = L.judge(docs, broadcast_lines=limit).collect()
        assert {g.doc_id for g in judged if g.n_removed_lines} == {*range(1, 30), 5000}
    got = {g.doc_id: g.text for g in C.quality(spark, docs, "").collect()}
    assert [i for i in range(2000) if line in got[i]] == [0] and all(rare in got[i] for i in range(100, 120)) and 5000 not in got


def test_rows_of_one_document_count_once(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    line = " ".join(word() for _ in range(8))
    rows = [(7, " ".join(word() for _ in range(30)) + "\n" + line, "h") for _ in range(25)] + [(None, " ".join(word() for _ in range(30)) + "\n" + line, "h") for _ in range(25)]
    got = L.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 50 and all(g.kept and g.n_removed_lines == 0 for g in got)


def test_a_partition_of_few_words(spark):
    rows = [(n, " ".join("abcdefghi"[:n]), "h") for n in range(10)]
    got = L.judge(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(10, "doc_id")).collect()
    assert {g.doc_id: g.n_words for g in got} == {n: n for n in range(10)} and not any(g.kept for g in got)
