"""Values worked out by hand, and plain versions, for features, metrics, resampling, contracts, sources and sinks."""

import gzip
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandworks.functions import censor, kernels, physchem, seq, text
from strandworks.operators import contracts, graph, joins, measure, metrics, resample, select, vectors
from strandworks.sources import fasta, tables
from strandworks.streaming import events as stream


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_feature_vector(spark):
    got = spark.createDataFrame([("ACDEFGHIK",)], "s string").select(*[c.alias(n) for n, c in physchem.features(F.col("s")).items()]).first()
    want = {"charge": -1.3810129760, "gravy": -0.3222222222, "moment": 0.3235743389, "aromaticity": 1 / 9, "boman": -0.3711111111, "isoelectric_point": 5.3219713211, "mass": 1019.1318, "entropy": math.log2(9), "cysteines": 1.0, "length": 9.0, "longest_run": 1.0}
    assert all(got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())
    odd = spark.createDataFrame([("ACX",), (None,), ("",)], "s string").select(physchem.features(F.col("s"))["charge"]).collect()
    assert [r[0] for r in odd] == [None, None, None]


def test_developability(spark):
    df = spark.createDataFrame([("GIGKFLHSAKKFGKAFVGEIMNS", 20.0), ("CCCILVILVIWWWW", 70.0), ("AK", None)], "s string, instability double")
    a, b, c = physchem.developability(df, "s").collect()
    assert a["reasons"] == [] and a["class"] in ("Good", "Excellent", "Moderate") and 0 <= a["developability"] <= 100
    assert "high_aggregation_risk" in b["reasons"] and "odd_cysteine_count" in b["reasons"] and b["aggregation"] == "High" and b["class"] != "Excellent"
    assert c["proteolysis"] == "High" and c["clean_stretch"] == 1
    one = spark.range(1)
    at = lambda x: one.select(physchem.trapezoid(F.lit(float(x)), 5, 8, 30, 50)).first()[0]
    assert [at(x) for x in (5, 6.5, 8, 30, 40, 60)] == [0, 50, 100, 100, 50, 0]


def plain_sections(s, x, instability):
    """The sections of a sequence, rule by rule, from its features ``x``; parts that aren't known are left out."""
    def slope(v, a, b, c, d):
        if v is None:
            return None
        if a is not None and v < b:
            return max(0.0, 100 * (v - a) / (b - a))
        return 100.0 if c is None or v <= c else max(0.0, 100 * (d - v) / (d - c))

    mean = lambda parts: (lambda known: sum(known) / len(known))([p for p in parts if p is not None])
    water = sum(c in "AVILMFWYC" for c in s) / len(s)
    solvent = sum((x["gravy"] <= 0.5, sum(physchem.EISENBERG[c] for c in s) / len(s) <= 0.4, abs(x["charge"]) >= 1, instability is None or instability < 40))
    by = {"Low": 100.0, "Medium": 60.0}
    return {
        "physicochemical": mean([slope(x["length"], 5, 8, 30, 50), slope(x["mass"], 500, 700, 3500, 5000), slope(x["charge"], -1, 0, 4, 6), slope(x["isoelectric_point"], 4, 5, 10, 11), slope(x["gravy"], -2, -1.2, 0.2, 0.8), slope(x["aromaticity"], None, None, 0.25, 0.4), slope(x["entropy"], 1.2, 2, None, None)]),
        "stability": mean([slope(instability, None, None, 40, 60), slope(x["hotspots"], None, None, 1, 6), 100.0 if s[0] in "GAVPMST" else 35.0 if s[0] in "RKLFWYI" else 70.0, by.get(x["proteolysis"], 20.0)]),
        "solubility": mean([slope(water, None, None, 0.45, 0.7), slope(x["moment"], 0.05, 0.15, 0.45, 0.65), 100.0 if solvent >= 3 else 65.0 if solvent == 2 else 25.0, by.get(x["aggregation"], 15.0)]),
        "synthesis": mean([slope(x["difficulty"], None, None, 3, 8), slope(x["length"], 5, 8, 30, 60), 100.0 if s.count("C") % 2 == 0 else 20.0]),
        "safety": mean([slope(max(x["charge"] - 6, 0), None, None, 0, 4), slope(x["aromaticity"], None, None, 0.3, 0.5), by.get(x["hemolysis"], 15.0)]),
    }


def test_developability_is_dealt_over_all_cores(spark, tmp_path):
    """A small file is one task; the scores of its rows are much work and must not stay in it."""
    from strandworks.plans.registry import QUERIES

    spark.createDataFrame([(i, "acdkrfwylmh"[: 3 + i % 8]) for i in range(200)], "p_partkey long, p_name string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES["developability"](spark, str(tmp_path)).withColumn("p", F.spark_partition_id()).collect()
    assert len({r.p for r in got}) > 1 and len(got) == 200


def test_developability_sections(spark):
    texts = ["GIGKFLHSAKKFGKAFVGEIMNS", "CCCILVILVIWWWW", "AK", "RRWQWRMKKLG", "DEDEDEDEDE", "NGNSDPQGHHHMMW", "KKKKKKKKKKKKKKKKKKKKKKKKKKKKKKKKKKKK"]
    rows_ = [(s, v) for s in texts for v in (None, 20.0, 47.0, 80.0)]
    for r in physchem.developability(spark.createDataFrame(rows_, "s string, instability double"), "s").collect():
        want = plain_sections(r["s"], r.asDict(), r["instability"])
        assert all(r[k] == pytest.approx(v, abs=1e-9) for k, v in want.items()), (r, want)
        score = 0.25 * (want["physicochemical"] + want["stability"] + want["solubility"]) + 0.15 * want["synthesis"] + 0.1 * want["safety"]
        assert r["developability"] == pytest.approx(score) and r["class"] == ("Excellent" if score >= 80 else "Good" if score >= 65 else "Moderate" if score >= 50 else "Low")
    known = physchem.developability(spark.createDataFrame([("AKA", 5.0), ("A", 5.0)], "s string, instability double"), "s", {"AK": 3.0, "KA": -1.5}).collect()
    assert known[0]["instability"] == pytest.approx(10 / 3 * 1.5) and known[1]["instability"] is None
    assert spark.createDataFrame([("AKAK",)], "s string").select(physchem.instability(F.col("s"), {"AK": 2.0})).first()[0] == pytest.approx(12.5)


def test_quantiles_and_names_of_ranks(spark):
    from strandworks.operators import aggregate, rank

    r = np.random.default_rng(7)
    data = [(g, float(v)) for g in ("a", "b", None) for v in r.integers(0, 9, 40)] + [("a", None), ("c", None), ("a", float("nan"))]
    df = spark.createDataFrame(data, "g string, v double")
    at = (0.0, 0.1, 0.5, 0.73, 1.0)
    for row in rank.quantiles(df, ["v"], at, ["g"])["v"].collect():
        own = [v for g, v in data if g == row["_b0"] and v is not None and v == v]
        assert np.allclose(row["q"], np.quantile(own, at))
    assert {x.g: x.p50 for x in aggregate.summary(df.where("NOT isnan(v) OR v IS NULL"), "v", ["g"]).collect()}.keys() == {"a", "b", "c", None}
    assert aggregate.summary(df.limit(0), "v").first()["p50"] is None
    named = df.where("g = 'a' AND NOT isnan(v)").select("v", F.lit(5).alias("v_before"), F.lit("x").alias("v_total"), F.lit(0).alias("v_v"))
    got = rank.min_rank(named, "v", "r")
    assert got.columns == ["v", "v_before", "v_total", "v_v", "r"] and got.where("v_before = 5 AND r >= 1").count() == 40


def test_text_functions(spark):
    df = spark.createDataFrame([("2 – 8", " µg / mL", "1, 3", "AB"), ("8-2", "μM", "1, 9", "z"), ("16", "IU", "x", "A"), (None, None, None, None)], "r string, u string, t string, c string")
    arts = F.array(*map(F.lit, "abc"))
    got = rows(df.select(text.interval(F.col("r")), text.unit(F.col("u")), text.references(F.col("t"), arts), text.cell_column(F.col("c"))))
    assert [x[0] and tuple(x[0]) for x in got] == [(2.0, 8.0), None, (16.0, 16.0), None] and [x[1] for x in got[:3]] == ["ug/ml", "um", "iu"]
    assert [x[2] for x in got] == [["a", "c"], [], [], []] and [x[3] for x in got[:3]] == [28, 26, 1]
    n = spark.createDataFrame([(0.123456789,), (1234.5,), (0.0,)], "x double").select(text.significant(F.col("x"), 3))
    assert [r[0] for r in n.collect()] == ["0.123", "1230", "0"]
    w = spark.createDataFrame([("AAAACGTNCCCC", "GGGGNACGTTTT")], "a string, b string").select(*[F.array_sort(F.concat(text.four_mers(F.col(c)), F.transform(text.four_mers(F.col(c)), text.reverse_complement))) for c in "ab"]).first()
    assert w[0] == w[1]


def test_scales_and_identities(spark):
    df = spark.createDataFrame([("ACAC", "CACA"), ("", "A")], "a string, b string")
    got = rows(df.select(seq.scale_mean(F.col("a"), {"A": 2.0}), seq.overlap_bound(F.col("a"), F.col("b"), "AC"), kernels.identity(F.col("a"), F.col("b"))))
    assert got == [(1.0, 4, 0.75), (None, 0, 0.0)]
    order = spark.createDataFrame([("c", 0), ("a", 1)], "k string, position int")
    assert [r.k for r in joins.in_order_of(spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), "k", order).collect()] == ["c", "a"]


def test_metrics(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.1, 0)], "p double, y int")
    m = metrics.binary(df, "p", "y").first()
    assert m.auroc == pytest.approx(0.75) and m.auprc == pytest.approx((1 + 2 / 3) / 2) and m.brier == pytest.approx((0.01 + 0.64 + 0.09 + 0.01) / 4)
    r = np.random.default_rng(2)
    a, b = r.normal(size=(60, 3)), r.normal(size=(80, 3)) * [1, 2, 0.5] + 1
    mk = lambda x: spark.createDataFrame([([float(c) for c in v],) for v in x], "v array<double>")
    ca, cb = np.cov(a.T), np.cov(b.T)
    w, v = np.linalg.eigh(ca)
    half = (v * np.sqrt(w)) @ v.T
    want = ((a.mean(0) - b.mean(0)) ** 2).sum() + np.trace(ca) + np.trace(cb) - 2 * np.sqrt(np.linalg.eigvalsh(half @ cb @ half)).sum()
    assert metrics.frechet(mk(a), mk(b), "v", 3) == pytest.approx(want)
    x = spark.createDataFrame([(i, f"g{i % 12}", float(i % 7), int(i % 7 > 3)) for i in range(120)], "id int, g string, x double, y int")
    cal = metrics.grouped_calibration(x, "g", ["x"], "y", 3, "s", "id").collect()
    assert len(cal) == 120 and {r.fold for r in cal} == {0, 1, 2} and np.mean([(r.probability > 0.5) == r.y for r in cal]) > 0.95


def test_resampling(spark):
    df = spark.createDataFrame([(i, float(i), i % 4) for i in range(40)], "k int, v double, g int")
    drawn = resample.cluster_draws(df, "k", {"s": F.sum("v")}, 5, 1)
    assert [r[1] for r in sorted(rows(drawn.groupBy("round").agg(F.sum("times"))))] == [40] * 5 and drawn.count() < 200
    panels = resample.random_panels(df, "k", ["v"], 4, 20).orderBy("draw").collect()
    g = np.random.default_rng(42)
    assert [r.v_mean for r in panels] == pytest.approx([np.mean(g.choice(40, 4, replace=False)) for _ in range(20)])
    seeded = resample.seeded_panels(df, "k", ["v"], 4, range(42, 45)).orderBy("draw").collect()
    assert [r.v_mean for r in seeded] == pytest.approx([np.mean(np.random.default_rng(s).choice(40, 4, replace=False)) for s in range(42, 45)])
    whole = dict((a, b) for a, b, _ in [(r.k, r.value, 0) for r in resample.error_trials(df, "k", "v", [-1.0, 0.0, 1.0], 1, 3).collect()])
    half = {r.k: r.value for r in resample.error_trials(df.where("k < 20"), "k", "v", [-1.0, 0.0, 1.0], 1, 3).collect()}
    assert all(whole[k] == half[k] and abs(half[k] - k) <= 1 for k in half)
    hits = spark.createDataFrame([(s, k, int(s < 50)) for s in range(100) for k in range(20)], "sc int, k int, hit int")
    s = resample.scenario_expectations(hits, "sc", "k", "hit", 5, 200).first()
    assert s.expected == pytest.approx(2.5) and s.scenario_std == pytest.approx(2.5) and s.panel_p10 == 0
    sub = select.fixed_subset(df, "k", 5, 7)
    assert sorted(r.k for r in sub.collect()) == sorted(np.random.default_rng(7).choice(40, 5, replace=False).tolist())
    d = resample.component_delta(spark.createDataFrame([(c, s, 1.0 + s) for c in range(6) for s in range(2)], "c int, s int, d double"), "c", "s", "d", 20).first()
    assert (d.macro, d.low, d.high, d.rounds) == (1.5, 1.5, 1.5, 20)


def test_contracts_of_runs(spark, tmp_path):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "s string, place int")
    b = a.orderBy(F.col("place").desc())
    assert contracts.library_identity(a, "s") == contracts.library_identity(b, "s") != contracts.library_identity(a.limit(1), "s")
    swapped = a.withColumn("place", 3 - F.col("place"))
    assert contracts.library_identity(a, "s", "place") != contracts.library_identity(swapped, "s", "place")
    contracts.require_repeat({"n": 1}, {"n": 1}, ["n"])
    with pytest.raises(joins.ContractError):
        contracts.require_repeat({"n": 1}, {}, ["n"])
    with pytest.raises(joins.ContractError):
        contracts.require_fresh("/a/b", ["/a/b/c"])
    contracts.require_fresh("/a/bc", ["/a/b"])
    (tmp_path / "f.txt").write_text("one")
    d = contracts.file_digest(spark, str(tmp_path / "f.txt"))
    contracts.require_unchanged(spark, {str(tmp_path / "f.txt"): d})
    (tmp_path / "f.txt").write_text("two")
    with pytest.raises(joins.ContractError):
        contracts.require_unchanged(spark, {str(tmp_path / "f.txt"): d})
    assert contracts.reusable({"settings": {"a": 1}, "members": contracts.library_identity(a, "s")}, {"a": 1}, a, "s")
    v = spark.createDataFrame([("x", [1.0, 2.0]), ("y", [float("nan"), 1.0])], "s string, v array<double>")
    assert contracts.require_covered_vectors(a.where("s = 'x'"), v, "s", "v", 2).count() == 1
    with pytest.raises(joins.ContractError):
        contracts.require_covered_vectors(a, v, "s", "v", 2)
    bad = spark.createDataFrame([(1, "ACDEFGHX"), (2, "ACDEFGH"), (3, "ACDEFGHI"), (4, "ACDEFGHI"), (5, "VNWKKILGKIIKVVK"), (6, "VNWKKILGKIIKVVA")], "k int, s string")
    ref = spark.createDataFrame([("VNWKKILGKIIKVVK",)], "s string")
    assert sorted(rows(contracts.record_issues(bad, "k", "s", "k", ref, 0.8))) == [(1, "invalid_alphabet"), (2, "length_out_of_range"), (4, "duplicate_sequence"), (5, "challenge_similarity_exceeded"), (5, "exact_reference_overlap"), (6, "challenge_similarity_exceeded")]
    with pytest.raises(joins.ContractError):
        joins.require_aligned(a, swapped, "s", ["place"])
    same = joins.pairs_within(spark.createDataFrame([(1, "abcd", "g"), (2, "abce", "g"), (3, "abcf", "h")], "id int, s string, grp string"), ["grp"], "s", 0.7, spark.createDataFrame([(2, 1)], "id_a int, id_b int"))
    assert [(r.id_a, r.id_b, r.known) for r in same.collect()] == [(1, 2, True)]
    with pytest.raises(Exception, match="several folds"):
        measure.fold_masks(spark.createDataFrame([("g", 1), ("g", 2)], "g string, f int"), "f", "g", 1).collect()


def test_sinks_and_sources(spark, tmp_path):
    df = spark.createDataFrame([(2, "KLM", 0.5), (1, "ACD", 0.123456789012)], "place int, s string, x double")
    for n in ("a", "b"):
        tables.write_gzip_csv(df, str(tmp_path / f"{n}.gz"), ["place"])
    assert (tmp_path / "a.gz").read_bytes() == (tmp_path / "b.gz").read_bytes() and gzip.open(tmp_path / "a.gz", "rt").read().startswith("place,s,x\n1,ACD,")
    assert sorted(rows(tables.read_csv(spark, str(tmp_path / "a.gz"), "place int, s string, x double")))[0][1] == "ACD"
    tables.write_ranking(df.withColumn("id", F.col("s")), str(tmp_path / "r.tsv"), "id", "s", "place")
    assert (tmp_path / "r.tsv").read_text().splitlines()[1:] == ["1\tACD\tACD\t1.000000", "2\tKLM\tKLM\t0.500000"]
    tables.write_predictions(df, str(tmp_path / "p.csv"), "place")
    assert (tmp_path / "p.csv").read_text().splitlines()[1] == "1,ACD,0.123456789"
    for html in (False, True):
        tables.write_report(df.select("place", F.lit("a|<b").alias("t")), str(tmp_path / "rep"), html=html)
    assert "&lt;b" in (tmp_path / "rep").read_text()
    with pytest.raises(joins.ContractError):
        tables.write_report(df, str(tmp_path / "rep"), most=1)
    cube = spark.createDataFrame([(a, b, 1.0) for a in "xy" for b in "pq"], "a string, b string, v double")
    tables.write_cube(cube, str(tmp_path / "cube"), ["a", "b"], "v")
    with pytest.raises(joins.ContractError):
        tables.write_cube(cube.limit(3), str(tmp_path / "cube2"), ["a", "b"], "v")
    asked = []

    def compute(missing):
        asked.append(missing.count())
        return missing.withColumn("v", F.length("s"))

    for _ in range(2):
        got = tables.through_cache(df.select("s"), str(tmp_path / "cache"), "s", {"m": 1}, compute)
        assert sorted(r.v for r in got.collect()) == [3, 3]
    tables.through_cache(df.select("s"), str(tmp_path / "cache"), "s", {"m": 2}, compute).count()
    assert asked == [2, 2]
    tables.publish(spark, lambda p: df.write.parquet(p), str(tmp_path / "out"))
    tables.publish(spark, lambda p: df.limit(1).write.parquet(p), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    with pytest.raises(ZeroDivisionError):
        tables.publish(spark, lambda p: 1 / 0, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    (tmp_path / "m.jsonl").write_text('{"id": 1, "part": "train"}\n{"id": 2, "part": "holdout"}\n')
    reg = tables.read_jsonl(spark, str(tmp_path / "m.jsonl"), "id int, part string").select("id", F.sha2(F.to_json(F.struct("id", "part")), 256).alias("sha"))
    assert tables.read_allowed(spark, str(tmp_path / "m.jsonl"), "id int, part string", "id", "part", ["quarantine"], reg).count() == 2
    for broken in (lambda: tables.read_allowed(spark, str(tmp_path / "m.jsonl"), "id int, part string", "id", "part", ["holdout"], reg), lambda: tables.read_allowed(spark, str(tmp_path / "m.jsonl"), "id int, part string", "id", "part", [], reg.limit(1))):
        with pytest.raises(joins.ContractError):
            broken()
    (tmp_path / "art.json").write_text('{"id": 4,\n "articles": [{"title": "A  b", "year": 2001}]}')
    assert tables.read_articles(spark, str(tmp_path / "art.json")).select("key").first()[0] == spark.range(1).select(censor.publication_key(F.lit("a B "), F.lit(2001))).first()[0]
    got, issues = tables.check_predictions(spark.createDataFrame([("a", "AC", 1.0, " hemo "), ("a", "AC", 2.0, "x"), ("z", "C", -1.0, "x")], "id string, s string, v double, l string"), spark.createDataFrame([("a", "AC"), ("b", "C")], "id string, s string"), "id", "s", "v", "l")
    assert sorted(rows(issues)) == [("repeated_id", 2), ("unknown_id", 1), ("value_not_positive", 1)] and got.where("id = 'b' AND v IS NULL").count() == 1
    with pytest.raises(joins.ContractError):
        tables.union_of({"a": (df, 3)})
    fasta.candidates_to_fasta(df.withColumn("ok", F.col("place") > 1), str(tmp_path / "c.fasta"), "place", "s", "ok", "place")
    assert (tmp_path / "c.fasta").read_text() == ">2\nKLM\n"
    h, s = fasta.headers_and_sequences(spark, str(tmp_path / "c.fasta"))
    assert (h.first().header, s.first().sequence, s.first().idx) == ("2", "KLM", 0)


def test_lineage_and_labels(spark):
    export = spark.createDataFrame([(1, "t", 5.0), (2, "t", 5.0), (3, "u", 7.0)], "id int, target string, value double")
    assays = spark.createDataFrame([(10, "t", 5.0), (11, "u", 8.0)], "assay int, target string, value double")
    got = {r.id: (r.match, r.status) for r in measure.lineage(export, assays, ["target", "value"], "assay").collect()}
    assert got == {1: (10, "same_assay"), 2: (10, "same_assay"), 3: (None, "single")}
    pool = vectors.mean_pool(F.array(F.array(F.lit(9.0)), F.array(F.lit(1.0)), F.array(F.lit(3.0)), F.array(F.lit(9.0))))
    assert spark.range(1).select(pool).first()[0] == [2.0]
    p = graph.joint_components(spark.range(6), spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "id long, key string"), spark.createDataFrame([(1, "x"), (2, "x"), (5, None)], "id long, key string"))
    assert dict(rows(p)) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5}


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 00:05:00", "a", 1.0), ("2024-01-01 00:05:00", "a", 1.0), ("2024-01-01 02:00:00", "a", 2.0), ("2024-01-01 00:10:00", "b", 9.0)], "ts string, k string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out in (("t", stream.tumbling(read, "ts", "k", "v")), ("s", stream.sessions(read, "ts", "k")), ("d", stream.distinct_events(read, "ts", ["k", "v"]))):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"c{name}")).start()
        q.processAllAvailable()
        q.stop()
    assert {(r.k, r.n, r.total) for r in spark.table("t").collect()} <= {("a", 2, 2.0), ("b", 1, 9.0), ("a", 1, 2.0)} and spark.table("t").count() >= 2
    assert spark.table("s").count() >= 2 and spark.table("d").count() == 3
    assert stream.distinct_events(df, "ts", ["k", "v"]).count() == 3


def test_nested_folds(spark):
    nodes = spark.range(24)
    pairs = spark.createDataFrame([(0, 1, 0.9), (2, 3, 0.5), (4, 5, 0.7)], "id_a long, id_b long, ratio double")
    papers = spark.createDataFrame([(1, "p"), (6, "p"), (7, None), (8, None)], "id long, key string")
    got = graph.nested_folds(nodes, pairs, papers, 0.6, 3, 2, "s").collect()
    root = {r.id: r.root for r in got}
    assert root[0] == root[1] == root[6] == 0 and root[2] == 2 and root[3] == 3 and root[5] == 4 and root[8] == 8
    outer = {r.id: r.outer for r in got}
    assert all(len({outer[i] for i in root if root[i] == k}) == 1 for k in set(root.values()))
    assert all(r.held != r.outer for r in got) and len(got) == 2 * 24
    for k in range(3):
        inner = {r.root: r.inner for r in got if r.held == k}
        assert all(inner[r.root] == r.inner for r in got if r.held == k) and set(inner.values()) == {0, 1}


def test_nested_folds_link_by_known_papers_and_part_what_there_is(spark):
    """A paper of an unknown id still links the known ones; fewer groups than folds: only folds that exist are held, a group alone has no fold."""
    papers = spark.createDataFrame([(-5, "p"), (1, "p"), (2, "p"), (3, "q")], "id long, key string")
    none = spark.createDataFrame([], "id_a long, id_b long, ratio double")
    got = graph.nested_folds(spark.range(1, 4), none, papers, 0.6, 3, 2, "s").collect()
    assert {tuple(r) for r in got} == {(3, 3, 1, 0, -1), (1, 1, 0, 1, -1), (2, 1, 0, 1, -1)}
    got = graph.nested_folds(spark.range(1, 3), none, papers, 0.6, 3, 2, "s").collect()
    assert {tuple(r) for r in got} == {(1, 1, -1, None, None), (2, 1, -1, None, None)}


def test_nested_folds_check_their_input(spark):
    papers = spark.createDataFrame([], "id long, key string")
    for ratio in (float("nan"), None, 1.5, -0.1):
        with pytest.raises(ValueError, match="ratios"):
            graph.nested_folds(spark.range(9), spark.createDataFrame([(0, 1, ratio)], "id_a long, id_b long, ratio double"), papers, 0.6, 3, 2, "s")
    with pytest.raises(ValueError, match="repeat"):
        graph.nested_folds(spark.range(9).unionByName(spark.range(1)), spark.createDataFrame([], "id_a long, id_b long, ratio double"), papers, 0.6, 3, 2, "s")


def test_nested_folds_audit_papers_and_inner_folds(spark, monkeypatch):
    none = spark.createDataFrame([], "id_a long, id_b long, ratio double")
    shared = spark.range(9).selectExpr("id", "'p' AS key")
    chain = spark.range(8).selectExpr("id AS id_a", "id + 1 AS id_b", "0.9D AS ratio")
    whole, fair = graph.components, graph.balanced_folds
    monkeypatch.setattr(graph, "components", lambda nodes, edges: whole(nodes, edges.limit(0)))
    with pytest.raises(RuntimeError, match="a paper crosses folds"):
        graph.nested_folds(spark.range(9), none, shared, 0.6, 3, 2, "s")
    with pytest.raises(RuntimeError, match="a similar pair crosses folds"):
        graph.nested_folds(spark.range(9), chain, shared.limit(0), 0.6, 3, 2, "s")
    monkeypatch.setattr(graph, "components", whole)
    both = lambda df, group, folds, seed: fair(df, group, folds, seed) if folds == 3 else df.select(group).distinct().crossJoin(spark.range(2).selectExpr("CAST(id AS int) AS fold"))
    monkeypatch.setattr(graph, "balanced_folds", both)
    with pytest.raises(RuntimeError, match="a component crosses folds"):
        graph.nested_folds(spark.range(9), none, shared.limit(0), 0.6, 3, 2, "s")


def test_nested_folds_measure_their_pairs(spark, tmp_path):
    """Suppliers that share most of their orders are one component; those with none or few in common aren't, whatever their numbers."""
    from strandworks.plans.registry import QUERIES

    spark.range(9).selectExpr("id AS s_suppkey", "CAST(id AS int) AS s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))
    sold = [(o, s) for o in range(4) for s in (1, 2)] + [(4, 1), (5, 0), (6, 4), (7, 5), (7, 4), (8, 4)]
    spark.createDataFrame(sold, "l_orderkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.id: r.root for r in QUERIES["nested_folds"](spark, str(tmp_path)).collect()}
    assert got == {i: {2: 1, 5: 4}.get(i, i) for i in range(9)}
