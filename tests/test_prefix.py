"""Selections by ordered prefixes: equal to tests of all rows, while only some are tested."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandworks.functions import kernels
from strandworks.operators import greedy, joins, prefix

RNG = np.random.default_rng(11)
WORDS = ["".join(RNG.choice(list("ACDE"), RNG.integers(3, 9))) for _ in range(60)]
ROWS = [(k, w, float(RNG.integers(0, 12))) for k, w in enumerate(WORDS)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "id long, s string, v double").cache()


def in_order(rows, up):
    return sorted(rows, key=lambda r: ((r[2] if up else -r[2]), r[0]))


@pytest.mark.parametrize("up", [True, False])
def test_prefixes_are_the_order_and_lose_nothing(table, up):
    parts = [sorted((r.v if up else -r.v, r.id) for r in p.collect()) for p in prefix.prefixes(table, [("v", up), ("id", True)], first=4)]
    assert [len(p) for p in parts] == [4, 4, 8, 16, 28]
    assert [k for p in parts for _, k in p] == [r[0] for r in in_order(ROWS, up)]
    assert [len(list(p.collect())) for p in prefix.prefixes(table, [("v", up), ("id", True)], first=25, most=25)] == [25, 25, 10]


def test_ties_stay_together_and_unusable_rows_go(spark):
    rows = [(1, 1.0), (2, 1.0), (3, 1.0), (4, 2.0), (5, None), (6, float("nan")), (7, float("inf"))]
    df = spark.createDataFrame(rows, "id long, v double")
    assert [sorted(r.id for r in p.collect()) for p in prefix.prefixes(df, [("v", True)], first=1)] == [[1, 2, 3], [4]]
    assert not list(prefix.prefixes(df.limit(0), [("v", True)]))
    with pytest.raises(ValueError):
        next(prefix.prefixes(df, [("v", True)], first=0))


def test_first_passing_tests_few_rows(spark, table):
    tested = spark.sparkContext.accumulator(0)

    def test(part):
        n = part.count()
        tested.add(n)
        return part.where("id % 2 = 0")

    got = prefix.first_passing(table, [("v", True), ("id", True)], test, 5, first=4)
    want = [r[0] for r in in_order(ROWS, True) if r[0] % 2 == 0]
    assert [r.id for r in got.collect()] == want[:5]
    need = [r[0] for r in in_order(ROWS, True)].index(want[4]) + 1
    assert need <= tested.value <= 2 * need + 4 and tested.value < len(ROWS)
    with pytest.raises(ValueError):
        prefix.first_passing(table, [("v", True)], test, 50, first=4)


def walk(rows, k, apart, fails):
    taken = []
    for key, s, _ in rows:
        if len(taken) < k and not fails(key, s) and all(kernels.local_ratio(s, t) <= apart for _, t in taken):
            taken.append((key, s))
    return [key for key, _ in taken]


@pytest.mark.parametrize("first", [6, 500])
def test_starter_equals_a_walk(spark, table, first):
    challenge, known = WORDS[3:5], WORDS[10:12]
    fails = lambda _, s: any(kernels.lcs_ratio(s, c) > 0.8 for c in challenge) or any(kernels.local_ratio(s, c) > 0.6 for c in known)
    texts = lambda x: spark.createDataFrame([(t,) for t in x], "s string")
    got = prefix.starter_top(table, "id", "s", "v", texts(challenge), texts(known), 5, within=4.0, first=first).orderBy("place").collect()
    want = walk(in_order(ROWS, True), 5, 0.4, fails)
    assert len(want) == 5 and [r.id for r in got] == want and [r.within for r in got] == [ROWS[k][2] <= 4 for k in want]
    with pytest.raises(ValueError):
        prefix.starter_top(table, "id", "s", "v", texts(challenge), texts(known), 60, first=first)


def test_screened_equals_a_walk_and_asks_for_few(spark, table):
    asked = []

    def screen(part):
        asked.extend(r.id for r in part.collect())
        return part.where("id % 3 > 0").select("id", F.when(F.col("id") % 5 > 0, F.col("id") % 2 == 0).alias("rejected"))  # no answer, and null: rejected

    got = prefix.screened_top(table, "id", "s", "v", "id", screen, 4, [greedy.Step(100, pairwise=0.7)], {"hard": F.col("v") > 10}, first=8)
    fails = lambda key, _: key % 3 == 0 or key % 5 == 0 or key % 2 == 0 or ROWS[key][2] > 10
    assert [r.id for r in got.orderBy("place").collect()] == walk(in_order(ROWS, False), 4, 0.7, fails)
    assert len(asked) == len(set(asked)) < len(ROWS)


def test_references_are_met_by_the_rows_given_only(spark):
    """The alignment isn't moved below the groups, to every row that they were made of."""
    names = spark.range(1000).selectExpr("id % 5 AS g", "concat('AC', id % 5) AS s").groupBy("s").agg(F.min("g").alias("id"))
    got = joins.above(names, spark.createDataFrame([("AC3",)], "s string"), "s", 0.9, local=True)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Aggregate") and "ArrowEvalPython" not in plan[plan.index("Aggregate") :]
    assert [r.id for r in got.collect()] == [3]
