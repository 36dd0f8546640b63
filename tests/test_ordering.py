"""Row numbers: hot keys, nulls, plans."""

from __future__ import annotations

import random

from tracesieve.operators.ordering import number_rows, numbered_parts


def test_numbers_over_hot_and_null_keys(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["a", None, "z"]), rng.choice([None, 1, 2]), i) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, j int, i long").repartition(7)
    got = {(r.k, r.j, r.i): r.n for r in number_rows(df, ["i"], "n", ["k", "j"]).collect()}
    seen = {}
    for k, j, i in sorted(rows, key=lambda r: r[2]):
        seen[k, j] = seen.get((k, j), 0) + 1
        assert got[k, j, i] == seen[k, j]
    assert len(got) == len(rows)
    alone = {r.i: r.n for r in number_rows(df, ["i"], "n").collect()}
    assert alone == {i: i + 1 for i in range(3000)}
    assert number_rows(df.limit(0), ["i"], "n", ["k"]).collect() == []


def test_numbers_take_one_exchange(spark):
    df = spark.range(100).selectExpr("id % 3 as k", "id as i")
    plan = numbered_parts(df, ["i"], "n", ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "rangepartitioning" in plan and "Window" not in plan
