"""Digests of key ranges against the comparison of all rows."""

from __future__ import annotations

import random

import pytest

from fieldloom.operators import digests
from fieldloom.operators.compare import compare_rows

KEYS = ["field", "cell"]


@pytest.mark.parametrize("ranges", [1, 7, 4096])
def test_differences_are_those_of_all_rows(spark, ranges):
    rng = random.Random(ranges)
    a = [(rng.choice(["T", "U", None]), rng.choice([None, *range(30)]), rng.choice([None, 0.0, 1.5, -0.0, float("nan")])) for _ in range(400)]
    b = [r if rng.random() < 0.9 else (r[0], r[1], 7.0) for r in a if rng.random() < 0.97] + [("V", 1, 2.0)]
    schema = "field string, cell int, value double"
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(rng.sample(b, len(b)), schema)
    fields, rows = digests.differing_rows(left, right, KEYS, "value", ranges=ranges)
    want = compare_rows(left, right, KEYS, "value").filter("state <> 'equal'")
    assert sorted(map(str, rows.collect())) == sorted(map(str, want.collect()))
    assert {r.field: (r.n_left, r.n_right) for r in fields.collect()} == {f: (sum(r[0] == f for r in a), sum(r[0] == f for r in b)) for f in {r[0] for r in a + b}}


def test_equal_runs_shuffle_digests_alone(spark):
    rows = spark.range(300_000).selectExpr("concat('f', id % 5) AS field", "id AS cell", "id / 7 AS value")
    plan = digests.range_digests(rows, rows.orderBy("cell"), KEYS, "value")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortAggregate" not in plan
    fields, different = digests.differing_rows(rows, rows.repartition(9), KEYS, "value")
    assert {(r.n_left, r.n_right, r.n_differing) for r in fields.collect()} == {(60_000, 60_000, 0)}
    assert different.isEmpty()
    one = rows.selectExpr("field", "cell", "CASE WHEN cell = 77 THEN null ELSE value END AS value")
    fields, different = digests.differing_rows(rows, one, KEYS, "value")
    assert sorted(r.n_differing for r in fields.collect()) == [0, 0, 0, 0, 1]
    assert [(r.field, r.cell, r.state) for r in different.collect()] == [("f2", 77, "different")]


def test_empty_runs(spark):
    rows = spark.createDataFrame([], "field string, cell int, value double")
    fields, different = digests.differing_rows(rows, rows, KEYS, "value")
    assert fields.count() == different.count() == 0
