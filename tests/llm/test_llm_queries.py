"""Each query opN and the pipeline on the smallest driver tables: names, types and rows, and its SQL where it has one."""

import math
import os

import duckdb
import pytest

import corpus_pipeline
from strandworks.llm.registry import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables")

# The columns that each query returns, and the table that it has a row for, if it has.
COLUMNS = {
    "op1_quality_rules": ("documents", "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean"),
    "op2_byte_bpe": ("documents", "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"),
    "op3_html_text": ("pages", "page_id bigint, url string, text string, n_chars bigint"),
    "op4_simhash": ("documents", "doc_id bigint, fingerprint string, component_id bigint"),
    "op5_warc": ("pages", "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"),
    "op6_bin_completion": (None, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"),
    "op7_rp_forest": ("embeddings", "vec_id bigint, n_links bigint, component_id bigint, kept boolean"),
    "op8_toxicity": ("documents", "doc_id bigint, held_out boolean, score double, predicted int"),
    "op9_pii": ("documents", "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"),
    "op10_chat_format": (None, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"),
    "op11_source_divergence": (None, "lang string, source string, part string, item string, value bigint, rank int"),
    "op12_hard_negatives": (None, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"),
    "op13_sharding": ("documents", "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int"),
}


def norm(rows):
    fix = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else round(x, 5) if isinstance(x, float) else x
    return sorted((tuple(map(fix, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DIR).cache()
    table, columns = COLUMNS[name]
    kinds = dict(df.dtypes)
    for c in columns.split(", "):
        n, kind = c.rsplit(" ", 1)
        assert kinds[n] == kind, c
    if table:
        assert df.count() == spark.read.parquet(f"{DIR}/{table}.parquet").count()
    if name in ORACLES:
        c = duckdb.connect()
        for f in os.listdir(DIR):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DIR}/{f}'")
        rel, cols = c.sql(ORACLES[name]), sorted(df.columns)
        assert sorted(rel.columns) == cols
        assert norm(tuple(r) for r in df.select(*cols).collect()) == norm(rel.select(*cols).fetchall())
    df.unpersist()


def test_contract_values(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    import hashlib

    for r in QUERIES["op2_byte_bpe"](spark, DIR).collect():
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    by = {}
    for r in QUERIES["op6_bin_completion"](spark, DIR).collect():
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in QUERIES["op8_toxicity"](spark, DIR).collect())
    assert min(r.conv_id for r in QUERIES["op10_chat_format"](spark, DIR).collect()) == -7


def test_pipeline_rows(spark):
    rows = corpus_pipeline.run(spark, DIR).collect()
    assert rows and {r.doc_id for r in rows} <= {r.doc_id for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


def test_pipeline_on_odd_rows(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words, "en", "s", 1, "x"), (1, words, "en", "s", 1, "x"), (1, words[::-1], "en", "s", 1, "x"), (None, words + " z", None, None, None, "x"), (2, None, "en", "s", 0, "x"), (3, "", "en", "s", 0, "x"), (4, " ".join(f"v{i}" for i in range(300_000)), "en", "s", 1, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r.doc_id for r in got if r.piece == 0]
    assert sorted(map(str, ids)) == ["1", "1", "4", "None"] and max(r.piece for r in got if r.doc_id == 4) > 100
