import random

import corpus_pipeline as C
from strandworks.llm import toxicity


def make(spark, tmp_path):
    r = random.Random(1)
    word = lambda: "".join(r.choice(["an", "he", "ti", "ou", "re", "st", "ed"]) for _ in range(3))
    docs, labels = [], []
    for i in range(260):
        words = [word() for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            for k in (5, 25, 45):
                words[k] = "zargok"
        docs.append((i, " ".join(words), "en", f"s{i % 3}", 1))
        labels.append((i, 1, int(bad)))
    docs += [(1000 + k, docs[1][1], "en", "s0", 1) for k in range(5)] + [(2000, "too short", "en", "s0", 1), (2001, None, None, None, None)]
    docs += [(2002, " ".join(word() for _ in range(40)) + " mail a.b@c.de now", "en", "s1", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return docs


def test_stages(spark, tmp_path):
    docs = make(spark, tmp_path)
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in C.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == C.COLUMNS, name
        df.write.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        df = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        kept.append({r.doc_id: r for r in df.collect()})
    bad = {d[0] for d in docs if "zargok" in (d[1] or "")}
    assert 2000 not in kept[0] and 2001 not in kept[0] and len(kept[0]) == len(docs) - 2
    assert len(bad & kept[1].keys()) <= 2 and len(kept[1]) >= len(kept[0]) - len(bad) - 4
    assert {1, *range(1000, 1005)} & kept[2].keys() == {1} & kept[1].keys()
    assert "<EMAIL>" in kept[3][2002].text and kept[3][2002].n_chars == len(kept[3][2002].text)
    rows = C.STAGES[-1][1](spark, df, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == kept[3].keys()


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0 and toxicity.THRESHOLD == 0.7
