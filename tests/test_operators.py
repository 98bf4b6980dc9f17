"""Small cases worked out by hand."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandworks.functions import censor, kernels, seq
from strandworks.operators import aggregate, graph, greedy, joins, measure, quota, rank, resample, select, vectors
from strandworks.sources import fasta, tables


def one(df):
    return [tuple(r) for r in df.collect()]


def test_percentile_score_ties(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([2.0, 1.0, 1.0, 4.0])] + [(4, None), (5, float("nan"))], "i int, v double")
    got = dict(one(rank.percentile_score(df, "v", "s").select("i", "s")))
    assert [got[i] for i in range(4)] == pytest.approx([2 / 3, 1 / 6, 1 / 6, 1]) and got[4] is None and got[5] is None
    back = dict(one(rank.percentile_score(df, "v", "s", reverse=True).select("i", "s")))
    assert [back[i] for i in range(4)] == pytest.approx([1 / 3, 5 / 6, 5 / 6, 0])
    single = spark.createDataFrame([(0, 7.0)], "i int, v double")
    assert one(rank.percentile_score(single, "v", "s").select("s")) == [(1.0,)]
    assert one(rank.percentile_score(single.limit(0), "v", "s")) == []


def test_two_rejection_rules(spark):
    rows = [("A" * 12, 0), ("bad", 1), ("A" * 12, 2), ("K" * 12, 3), ("K" * 12, 4), ("bad", 5)]
    df = spark.createDataFrame(rows, "s string, n int")
    ref = spark.createDataFrame([("K" * 12,)], "s string")
    a = one(select.mark_all_seen(df, ref, "s", "n", seq.alphabet_ok(F.col("s"))).orderBy("n").select("reason"))
    b = one(select.mark_accepted_seen(df, ref, "s", "n", seq.alphabet_ok(F.col("s"))).orderBy("n").select("reason"))
    assert [x[0] for x in a] == [None, "invalid", "duplicate", "reference_overlap", "duplicate", "invalid"]
    assert [x[0] for x in b] == [None, "invalid", "duplicate", "reference_overlap", "reference_overlap", "invalid"]


def test_quotas(spark):
    w = spark.createDataFrame([(10, 1.0), (11, 1.0), (12, 1.0)], "k int, w double")
    assert sorted(one(quota.largest_remainder(w, "k", "w", 10))) == [(10, 4), (11, 3), (12, 3)]
    seen = spark.createDataFrame([(10,), (11,), (11,)], "k int")
    assert sorted(one(quota.length_quotas(seen, "k", 31, 10, 12, None))) == [(10, 11), (11, 10), (12, 10)]
    q = dict(one(quota.length_quotas(seen, "k", 31, 10, 12)))
    assert q[11] > q[10] > q[12] and sum(q.values()) == 31


def unit_by_unit(size, weights, room):
    """Quotas by dealing: units go, one at a time, to the key furthest behind its due, never beyond the next whole number above it.

    Dues are shares of the units left, by weight or, where no open key has any, by room; they are set anew
    once no key may take another unit.
    """
    held, due, dealt = Counter(), {}, Counter()
    may = lambda k: held[k] < room[k] and dealt[k] <= due[k] // 1
    for left in range(size, 0, -1):
        if not any(map(may, due)):
            by = {k: weights.get(k, 0.0) for k in room if held[k] < room[k]}
            by = by if any(by.values()) else {k: float(room[k] - held[k]) for k in by}
            due, dealt = {k: left * w / sum(by.values()) for k, w in by.items()}, Counter()
        unit = min(filter(may, due), key=lambda k: (dealt[k] - due[k], k))
        held[unit] += 1
        dealt[unit] += 1
    return {k: held[k] for k in room}


def test_bounded_quotas_match_their_rule(spark):
    r = np.random.default_rng(2)
    rows, want = [], {}
    for g in range(120):
        n = int(r.integers(1, 7))
        cap = {k: int(r.integers(0, 9)) for k in range(n)}
        weights = {k: float(r.integers(0, 5)) for k in range(n) if r.random() < 0.8}
        size = int(r.integers(0, sum(cap.values()) + 1))
        rows += [(g, k, weights.get(k), cap[k], size) for k in cap]
        want |= {(g, k): n for k, n in unit_by_unit(size, weights, cap).items()}
    table = spark.createDataFrame(rows, "g int, k int, w double, c int, n int")
    assert {(a, b): n for a, b, n in one(quota.bounded_quotas(table, "g", "k", "w", "c", "n"))} == want
    with pytest.raises(Exception, match="fewer rows"):
        quota.bounded_quotas(spark.createDataFrame([(1, 1, 1.0, 1, 2)], "g int, k int, w double, c int, n int"), "g", "k", "w", "c", "n").collect()


def test_redistribution_and_libraries(spark):
    t = spark.createDataFrame([(10, 2, 3), (11, 2, 0), (12, 2, 3)], "k int, want int, have int")
    quotas, moves = quota.redistribute(t, "k", "want", "have")
    assert sorted(one(quotas)) == [(10, 3), (11, 0), (12, 3)] and sorted(one(moves)) == [(11, 10, 1), (11, 12, 1)]
    with pytest.raises(Exception, match="fewer rows"):
        quota.redistribute(spark.createDataFrame([(1, 5, 2)], "k int, want int, have int"), "k", "want", "have")[0].collect()
    rows = [(i, 10 if i < 6 else 11, i % 3, float(i % 3), float(i % 2)) for i in range(12)]
    pool = spark.createDataFrame(rows, "raw int, length int, cluster int, p double, e double")
    q = spark.createDataFrame([(10, 4), (11, 4)], "length int, quota long")
    order = [F.col("p"), F.col("e"), F.col("raw")]
    assert sorted(r.raw for r in quota.library(pool, "L0", 8, None, "length", "cluster", order, "raw").collect()) == list(range(8))
    for v in ("L1", "L2"):
        got = quota.library(pool, v, 8, q, "length", "cluster", order, "raw").collect()
        assert sorted(r.length for r in got) == [10] * 4 + [11] * 4 and (v == "L1" or {r.cluster for r in got} == {0, 1, 2})


def test_reference_mix(spark):
    mk = lambda s: spark.createDataFrame([(c, i, 10 if i < 4 else 20, [0, 0, 1, 1, 0, 1][i]) for i, c in enumerate("ABCDEF") if c in s], "s string, raw int, length int, cluster int")
    reference = spark.createDataFrame([("x", 10, 1), ("y", 20, 1)], "s string, length int, cluster int")
    for fraction, want in ((1.0, "CDF"), (0.0, "ABE")):
        got = quota.reference_mix(mk("ABCDEF"), mk("ABE"), reference, "length", "cluster", [F.col("raw")], fraction)
        assert sorted(r.s for r in got.collect()) == list(want)


def test_mix(spark):
    mk = lambda s: spark.createDataFrame([(c, i) for i, c in enumerate(s)], "s string, n int")
    got = select.mix(mk("ABCDE"), mk("FFA"), "s", "n", 5, 0.5)
    assert sorted((r.s, r.origin) for r in got.collect()) == [("A", "base"), ("B", "base"), ("C", "base"), ("D", "base"), ("F", "donor")]


def test_cube(spark):
    rows = [("s", m, t, 8.0 if m < 4 else 32.0) for m in range(8) for t in range(11)]
    r = aggregate.cube(spark.createDataFrame(rows, "s string, m int, t int, v double"), "s", "t", "v").first()
    assert (r.broad_mean, r.vote, r.mad_log2) == (20.0, 0.5, 1.0) and r.median_log2 == r.q90_log2 == pytest.approx(np.log2(20)) == pytest.approx(r.worst3_log2)


def test_similarities(spark):
    pairs = [("AAAAAAAACC", "AAAAAAAAAA"), ("A" * 39 + "C" * 11, "A" * 50), ("VNWKKILGKIIKVVK", "VNWKKILGKIIKVVA"), ("", ""), (None, "A")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in one(df.select(kernels.ratio(F.col("a"), F.col("b"))))] == [pytest.approx(0.8), pytest.approx(0.78), pytest.approx(14 / 15), 1.0, None]
    loc = spark.createDataFrame([("ACDEFGHI", "ACDEFGHI"), ("ACDEFGHI", "XXXXACDE"), ("A" * 8, "C" * 8)], "a string, b string")
    assert [r[0] for r in one(loc.select(kernels.local_similarity(F.col("a"), F.col("b"))))] == [1.0, 0.5, 0.0]


@pytest.mark.parametrize("least,measure", [(0.6, None), (0.6, "identity")])
def test_similar_pairs_by_rare_letters(spark, least, measure):
    r = np.random.default_rng(2)
    texts = ["".join(r.choice(list("abcdefgh"), int(r.integers(0, 12)))) for _ in range(90)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, s string")
    of = kernels.lcs_identity if measure else kernels.lcs_ratio
    got = {(a, b) for a, b, _ in one(joins.similar_pairs(df, df, "s", least, itself=True, measure=kernels.identity if measure else None))}
    assert got == {(i, j) for i in range(90) for j in range(i + 1, 90) if of(texts[i], texts[j]) >= least and (texts[i] + texts[j] or not measure)}
    near = {x.id for x in joins.above(df.where("id < 40"), df.where("id >= 70"), "s", 0.5, local=True).collect()}
    assert near == {i for i in range(40) if any(kernels.local_ratio(texts[i], texts[j]) > 0.5 for j in range(70, 90))}
    top = dict(one(joins.max_similarity(df.where("id < 40"), df.where("id >= 70"), "s", "id", local=True)))
    assert all(abs(top[i] - max(kernels.local_ratio(texts[i], texts[j]) for j in range(70, 90))) < 1e-12 for i in range(40))
    clear = {x.id for x in joins.clear_of(df.where("id < 40"), df.where("id >= 70"), "s", "id", 0.6).collect()}
    assert clear == {i for i in range(40) if all(kernels.lcs_ratio(texts[i], texts[j]) <= 0.6 for j in range(70, 90))}


def test_similar_pairs_match_brute_force(spark):
    r = np.random.default_rng(1)
    texts = ["".join(r.choice(list("abc d"), int(r.integers(0, 14)))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, s string")
    got = {(a, b) for a, b, _ in one(joins.similar_pairs(df, df, "s", 0.8, itself=True))}
    lcs = kernels.lcs_length
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if len(texts[i]) + len(texts[j]) == 0 or 2 * lcs(texts[i], texts[j]) / (len(texts[i]) + len(texts[j])) >= 0.8}
    assert got == want
    top = dict(one(joins.max_similarity(df.limit(20), df.where("id > 100"), "s", "id")))
    for i in range(20):
        assert top[i] == pytest.approx(max(1.0 if not texts[i] + texts[j] else 2 * lcs(texts[i], texts[j]) / (len(texts[i]) + len(texts[j])) for j in range(101, 120)))


def test_censoring(spark):
    raw = [" > 16 ", "≤8", "2.5e1", "", "nan", "inf", "0", "-1", "2-8", "~16", None]
    got = one(spark.createDataFrame([(x,) for x in raw], "r string").select(censor.parse(F.col("r")).alias("p")))
    assert [x[0] and tuple(x[0]) for x in got] == [(">", 16.0), ("<=", 8.0), ("=", 25.0)] + [None] * 8
    cases = [("<", 16.0, 1), ("<=", 16.0, 1), (">", 16.0, 0), (">=", 16.0, None), (">", 8.0, None), ("<", 32.0, None), ("=", 16.0, 1), ("=", 32.0, 0)]
    df = spark.createDataFrame(cases, "r string, v double, want int")
    assert all(r.got == r.want for r in df.withColumn("got", censor.label(F.col("r"), F.col("v"))).collect())
    b = lambda r, v: censor.bounds(F.lit(r), F.lit(v))
    row = spark.range(1).select(censor.ratio_bounds(b("=", 16.0), b(">", 128.0), 8.0).alias("x"), censor.ratio_bounds(b("=", 16.0), b(">", 128.0), 16.0).alias("y")).first()
    assert tuple(row.x) == (1, 1) and tuple(row.y) == (0, 1)


def test_components_and_folds(spark):
    nodes = spark.range(100)
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 59)] + [(70, 80), (80, 90), (5, 5)], "a long, b long")
    got = dict(one(graph.components(nodes, edges)))
    assert all(got[i] == 0 for i in range(60)) and got[70] == got[80] == got[90] == 70 and got[99] == 99


def test_balanced_folds_match_one_by_one(spark):
    import hashlib

    r = np.random.default_rng(6)
    sizes = {f"g{i}": int(n) for i, n in enumerate(r.integers(1, 12, 150))} | {"big": 90}
    df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "g string")
    got = {g: (n, f) for g, n, f in one(graph.balanced_folds(df, "g", 5, "s", chunk=4))}
    load, want = [0] * 5, {}
    for g in sorted(sizes, key=lambda g: (-sizes[g], hashlib.sha256(f"s:{g}".encode()).hexdigest())):
        want[g] = (sizes[g], load.index(min(load)))
        load[want[g][1]] += sizes[g]
    assert got == want


LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def pool(spark, r, n=40):
    texts = ["".join(r.choice(list(LETTERS[:6]), int(r.integers(8, 14)))) for _ in range(n)]
    return texts, spark.createDataFrame([(i, t, float(n - i), i % 3) for i, t in enumerate(texts)], "id int, s string, score double, cluster int")


def test_diverse_top(spark):
    r = np.random.default_rng(4)
    texts, df = pool(spark, r)
    step = greedy.Step(30, 4, 0.5)
    got = greedy.diverse_top(df, "id", "s", "score", "id", 6, [greedy.Step(5, 1, 0.1), step], {"hard": F.col("id") == 2, "external": F.col("id") == 0}, "cluster").collect()
    taken, used = [], {}
    for i, t in enumerate(texts[:30]):
        if i in (0, 2) or any(kernels.local_ratio(t, texts[j]) > 0.5 for j in taken) or used.get(i % 3, 0) >= 4:
            continue
        taken.append(i)
        used[i % 3] = used.get(i % 3, 0) + 1
        if len(taken) == 6:
            break
    assert [x.id for x in sorted(got, key=lambda x: x.place)] == taken and {x.step for x in got} == {1} and "external=1" in got[0].failed
    with pytest.raises(Exception, match="infeasible"):
        greedy.diverse_top(df, "id", "s", "score", "id", 6, [greedy.Step(3)], {}).collect()
    one_cluster = spark.createDataFrame([(i, (LETTERS[i] * 8), 1.0 - i / 100, 0) for i in range(12)], "id int, s string, score double, cluster int")
    ladder = [greedy.Step(12, 5, 0.5), greedy.Step(12, 5, 0.5), greedy.Step(12, 8, 0.5), greedy.Step(12, 8, 0.55)]
    assert {x.step for x in greedy.diverse_top(one_cluster, "id", "s", "score", "id", 6, ladder, {}, "cluster").collect()} == {2}


def test_portfolio_matches_one_by_one(spark):
    r = np.random.default_rng(8)
    score = np.round(r.random((60, 7)), 1)  # ties
    score[5] = score[4]
    groups = {i: f"g{i % 9}" for i in range(60)}
    hits = spark.createDataFrame([(i, f"s{j}", float(score[i, j])) for i in range(60) for j in range(7)], "id int, sc string, v double").repartition(6)
    of = spark.createDataFrame(list(groups.items()), "id int, grp string")
    for tail, cap in ((None, None), (0.3, None), (0.3, 1), (None, 2)):
        total, want, used = np.zeros(7), [], {}
        worst = 7 if tail is None else 3
        for _ in range(6):
            open_ = [i for i in range(60) if i not in want and (cap is None or used.get(groups[i], 0) < cap)]
            best = max(open_, key=lambda i: (np.sort(score[i] + total)[:worst].mean(), -i))
            want.append(best)
            total = total + score[best]
            used[groups[best]] = used.get(groups[best], 0) + 1
        got = greedy.portfolio(hits, "id", "sc", "v", 6, tail=tail, groups=of if cap else None, cap=cap).orderBy("place").collect()
        assert [x.id for x in got] == want
    with pytest.raises(ValueError, match="every scenario"):
        greedy.portfolio(hits.where("id <> 3 OR sc <> 's1'"), "id", "sc", "v", 2)
    with pytest.raises(ValueError, match="too few"):
        greedy.portfolio(hits, "id", "sc", "v", 12, groups=of, cap=1)


def test_adopted_top_and_portfolios(spark):
    df = spark.createDataFrame([("A" * 9, 1, 0.9), ("C" * 9, 2, 0.8), ("D" * 9, 3, 0.7)], "s string, raw int, consensus double").withColumn("id", F.col("raw"))
    got = greedy.adopted_top(df, df.where("raw > 1").select("s"), "id", "s", "consensus", "raw", 1, 10, {}).collect()
    assert [x.id for x in got] == [2]
    hits = spark.createDataFrame([(i, s, float(v)) for s, row in enumerate([(1, 1, 0), (0, 0, 1)]) for i, v in enumerate(row)], "id int, sc int, v double")
    assert [x.id for x in greedy.portfolio(hits, "id", "sc", "v", 2).orderBy("place").collect()] == [0, 1]
    assert [x.id for x in greedy.portfolio(hits, "id", "sc", "v", 2, tail=0.1).orderBy("place").collect()] == [0, 2]
    assert [x.id for x in greedy.portfolio(hits, "id", "sc", "v", 2, groups=hits.select("id", F.when(F.col("id") < 2, "a").otherwise("b").alias("grp")).distinct(), cap=1).orderBy("place").collect()] == [0, 2]
    r = np.random.default_rng(2)
    arms = r.random((12, 3))
    arm_df = spark.createDataFrame([(i, LETTERS[i] * 8, i, *map(float, a), float(r.random())) for i, a in enumerate(arms)], "id int, s string, raw int, a double, b double, c double, consensus double")
    order, seen, at = [], set(), [sorted(range(12), key=lambda i: -arms[i, k]) for k in range(3)]
    for t in range(12):
        pick = next(i for i in at[t % 3] if i not in seen)
        seen.add(pick)
        order.append(pick)
    assert [x.id for x in greedy.interleave(arm_df, "id", ["a", "b", "c"], ["raw", "s"]).orderBy("place").collect()] == order
    roles = greedy.quota_portfolio(arm_df, "id", "s", ["a", "b", "c"], "consensus", "raw", 5, 0.4, greedy.Step(100), {}).collect()
    assert {x.id for x in roles if x.role == "specialist"} == set(order[:2]) and len(roles) == 5


def test_contracts(spark):
    a, b = spark.createDataFrame([(1,), (1,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    assert joins.join_many_to_one(a, b, ["k"]).count() == 2
    with pytest.raises(joins.ContractError):
        joins.join_one_to_one(a, b, ["k"])
    with pytest.raises(joins.ContractError):
        joins.require_covered(a, b.limit(0), ["k"])
    m = spark.createDataFrame([("p", "t", "uM", "="), ("p", "t", "mg", "~"), (None, "u", "uM", ">")], "k string, t string, u string, r string")
    assert sorted(one(tables.check_measurements(m, "k", "t", "u", "r", ["t"]))) == [("null_field", 1), ("repeated_measurement", 1), ("unknown_relation", 1), ("unknown_target", 1), ("unknown_unit", 1)]


def test_bootstrap_and_draws(spark):
    df = spark.createDataFrame([(i % 50, float(i)) for i in range(500)], "g int, v double")
    r = resample.cluster_bootstrap(df, "g", "v", 40).first()
    assert r.low <= r.mid <= r.high and abs(r.mid - 249.5) < 40
    idx = resample.draws(spark, 10, 4, 20)
    assert idx.groupBy("draw").agg(F.countDistinct("position").alias("n")).where("n <> 4").count() == 0
    assert one(idx) == one(resample.draws(spark, 10, 4, 20))


def test_fasta_round_trip(spark, tmp_path):
    p = tmp_path / "a.fasta"
    p.write_text(">one desc\nacd\nEFG\n>two\r\nKLM\r\n>three\nAAA")
    got = fasta.read_fasta(spark, str(p)).orderBy("idx").select("header", "sequence").collect()
    assert [tuple(r) for r in got] == [("one desc", "ACDEFG"), ("two", "KLM"), ("three", "AAA")]
    fasta.write_fasta(fasta.read_fasta(spark, str(p)), str(tmp_path / "out"))
    assert fasta.read_fasta(spark, str(tmp_path / "out")).count() == 3
    for bad in ("", "ACD\n>x\nAAA", ">\nAAA", ">x\n>y\nAAA"):
        p.write_text(bad)
        with pytest.raises(joins.ContractError):
            fasta.read_fasta(spark, str(p))
    p.write_text("ACD\n>x\nAAA\n>y\n")
    assert [r.sequence for r in fasta.read_fasta(spark, str(p), strict=False).collect()] == ["AAA"]


def test_pareto_matches_brute_force(spark):
    r = np.random.default_rng(3)
    rows = [(i, *map(float, r.integers(0, 12, 3))) for i in range(200)] + [(900, None, 1.0, 1.0)]
    got = {x.i for x in select.pareto_front(spark.createDataFrame(rows, "i int, a double, b double, c double"), {"a": True, "b": False, "c": True}).collect()}
    pts = {i: (a, -b, c) for i, a, b, c in rows if a is not None}
    beat = lambda x, y: all(p >= q for p, q in zip(x, y)) and x != y
    assert got == {i for i, x in pts.items() if not any(beat(y, x) for y in pts.values())}


def test_average_rank_over_many_values(spark):
    r = np.random.default_rng(9)
    vals = [float(v) for v in r.integers(0, 700, 1500)]
    df = spark.createDataFrame(list(enumerate(vals)), "i int, v double")
    for up in (True, False):
        got = dict(one(rank.with_average_rank(df, "v", "r", ascending=up).select("i", "r")))
        s = sorted(vals, reverse=not up)
        assert all(got[i] == s.index(v) + (s.count(v) + 1) / 2 for i, v in enumerate(vals))


def test_references_beyond_one_block(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=4)]) for i in range(60)] + [(90, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    ref = np.array([v for i, v in rows if v and i < 37])
    for k, most in ((5, 10), (4, 3)):
        got = {x.id: x.distance for x in vectors.knn_median(df, df.where("id < 37 OR id = 90"), "id", "v", k, most).collect()}
        want = {i: np.median(np.sort(np.linalg.norm(ref - np.array(v), axis=1))[:k]) for i, v in rows if v}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)
    texts = [(i, "".join(r.choice(list("abcd"), r.integers(1, 20)))) for i in range(40)] + [(90, None)]
    t = spark.createDataFrame(texts, "id long, s string")
    whole = {x.id: x.max_ratio for x in joins.max_similarity(t, t.where("id >= 15"), "s", "id").collect()}
    parts = {x.id: x.max_ratio for x in joins.max_similarity(t, t.where("id >= 15"), "s", "id", most_rows=4).collect()}
    assert whole == parts and parts[90] is None and all(parts[i] == 1.0 for i in range(15, 40))
    assert all(abs(parts[i] - max(2 * kernels.lcs_length(s, o) / (len(s) + len(o)) for j, o in texts if j >= 15 and o)) < 1e-12 for i, s in texts if s)


def test_similarity_to_reference_reads_whole_texts(spark, tmp_path):
    from strandworks.plans.registry import QUERIES

    start = "the same beginning of forty characters.. "
    docs = [(1, start + "abcabcabc" * 10), (2, "zzz " * 20 + start), (3, None)]
    refs = [(7, start + "xyxyxyxy" * 12), (8, "unlike " * 9)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(refs, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.id: r.max_ratio for r in QUERIES["max_similarity_to_reference"](spark, str(tmp_path)).collect()}
    want = {i: max(2 * kernels.lcs_length(d, r) / (len(d) + len(r)) for _, r in refs) for i, d in docs if d}
    assert got == want | {3: None} and got[1] < 0.5


def test_max_similarity_is_dealt_over_all_cores(spark, tmp_path):
    """A small file is one task, and a text against a reference set is much work: its rows must not stay in one task."""
    texts = spark.createDataFrame([(i, "abc" * (i % 5) + "d" * (i % 3)) for i in range(200)], "id long, s string").coalesce(1)
    got = joins.max_similarity(texts, spark.createDataFrame([(1, "abcd"), (2, "dd")], "id long, s string"), "s", "id")
    assert got.withColumn("p", F.spark_partition_id()).groupBy("p").count().count() > 1


def test_subsequences_with_many_texts_at_once():
    import random

    r = random.Random(3)
    for alphabet in ("ab", "abc\0", "aé😀"):
        some = lambda n, a=alphabet: "".join(r.choice(a) for _ in range(r.randrange(n)))
        text, others = some(80), [some(99) for _ in range(7)]
        assert kernels.lcs_lengths(text, others) == [kernels.lcs_length(text, o) for o in others]


def test_size_estimates_do_not_grow_with_the_rounds(spark):
    """A cut has the size of its files; a plan's estimate, which joins multiply, had thousands of digits after a few rounds."""
    n = spark.range(200).select("id")
    got = graph.components(n, n.selectExpr("id AS a", "id + 1 AS b").where("b < 200"))
    assert got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1e9
    assert {r["root"] for r in got.collect()} == {0}


def test_components_settle_whatever_the_order_of_ids(spark):
    """0, 150, 149, .., 1 in a row: all but 0 first agree on 1, whose label must then fall at once, not a neighbour a round."""
    n = spark.range(151)
    edges = n.selectExpr("id AS a", "IF(id = 0, 150, id - 1) AS b").where("b > 0")
    assert {r.root for r in graph.components(n, edges).collect()} == {0}


def test_places_of_balanced_folds_are_never_broadcast(spark):
    """There are as many as groups, though the plan rates them by their few levels."""
    got = graph.balanced_folds(spark.range(500).selectExpr("id AS g"), "g", 3, "42")
    plan = got._jdf.queryExecution().executedPlan().toString()
    joins_ = [line for line in plan.splitlines() if "Join [" in line and "_size#" in line]
    assert joins_ and all("SortMergeJoin" in line for line in joins_)


def test_common_names_stay_with_their_rows(spark, monkeypatch):
    """Few aliases go to the rows, so that a name that all rows have isn't one task; many are joined by a shuffle, with the same rows."""
    rows = spark.range(50).selectExpr("id", "IF(id % 7 = 0, CAST(NULL AS string), concat('n', id % 2)) AS name")
    aliases = spark.createDataFrame([("n0", "N")], "alias string, canonical string")
    want = {i: "N" if i % 7 and i % 2 == 0 else None for i in range(50)}
    for few, sent in ((measure.FEW, True), (0, False)):
        monkeypatch.setattr(measure, "FEW", few)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        try:
            got = measure.canonical_names(rows, "name", aliases, "known")
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert ("BroadcastHashJoin" in plan) == sent and {r.id: r.known for r in got.collect()} == want
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pairs_are_made_by_tasks_of_bounded_rows(spark):
    df = spark.range(1000).selectExpr("id % 50 AS k", "id")
    dealt = graph.dealt(df, "k", rows=100)
    assert dealt.rdd.getNumPartitions() == 10 and sorted(r.id for r in dealt.collect()) == list(range(1000))
    assert graph.dealt(df, "k").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
