"""Each query with SQL gives the rows that DuckDB gives on the smallest driver tables."""

import math
import os

import duckdb
import pytest

from strandworks.plans.registry import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DIR}/{f}'")
    return c


def norm(rows):
    fix = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else round(float(x), 5) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted((tuple(fix(x) for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    want = rel.select(*[f'"{c}"' for c in cols]).fetchall()
    assert norm(got) == norm(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    """Queries without SQL give rows; what these are is tested operator by operator."""
    df = QUERIES[name](spark, DIR)
    assert df.columns and df.count() > 0


def test_components_of_orders_match_union_find(spark, duck):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    first = {}
    for order, part in duck.sql("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey % 3 > 0 AND l_orderkey % 11 = 0").fetchall():
        a, b = sorted((find(first.setdefault(order, part)), find(part)))
        root[b] = a
    from pyspark.sql import functions as F

    from strandworks.operators import graph

    l = spark.read.parquet(f"{DIR}/lineitem.parquet").where("l_partkey % 3 > 0 AND l_orderkey % 11 = 0")
    got = graph.joint_components(l.select(F.col("l_partkey").alias("id")), l.select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("key")))
    assert {r.id: r.root for r in got.collect()} == {p: find(p) for p in root}
    whole = {r.id: r.root for r in QUERIES["components_of_orders"](spark, DIR).collect()}
    assert len(whole) == duck.sql("SELECT count(DISTINCT l_partkey) FROM lineitem").fetchall()[0][0] and all(whole[v] == v <= k for k, v in whole.items())
