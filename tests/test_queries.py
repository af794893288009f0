"""Every registered query against its SQL, and its plan."""

from __future__ import annotations

import sys

import pytest
from oracle import compare, connect

import __spark_entry__ as driver
from fieldloom.plans.catalog import all_queries

QUERIES = all_queries()
UNWANTED = ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _check_plan(df) -> None:
    """No Python in the plan, and no pairing of everything with everything."""
    plan = _plan(df)
    for word in UNWANTED:
        assert word not in plan, word


@pytest.mark.parametrize("key", list(QUERIES))
def test_query(spark, sf_dir, con, key):
    run, sql = QUERIES[key]
    made = []

    def once(spark, sf_dir):
        made.append(run(spark, sf_dir))
        return made[0]

    if sql is None:
        assert not once(spark, sf_dir).isEmpty()
    else:
        assert compare(spark, sf_dir, once, sql, con) == []
    _check_plan(made[0])


def test_entry_has_rows(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry_without_the_optional_parts(monkeypatch):
    for name in driver.OPTIONAL:
        monkeypatch.setitem(sys.modules, name, None)
    assert set(driver.queries()) == set(QUERIES)


def test_other_import_errors_are_not_hidden(monkeypatch):
    def broken(name):
        raise ModuleNotFoundError("no numpy", name="numpy")

    monkeypatch.setattr(driver, "import_module", broken)
    with pytest.raises(ModuleNotFoundError, match="numpy"):
        driver.queries()


def test_ensemble_smaller_than_its_fields_is_refused(spark):
    """The smallest data set has ten suppliers and twelve fields."""
    with pytest.raises(ValueError, match="cannot judge"):
        QUERIES["consistency_job"][0](spark, "/root/testdata/sf0.001")


def test_flagship_plan(spark, sf_dir):
    """One shuffle, hash aggregation on both sides of it, and only the columns it needs."""
    plan = _plan(QUERIES["history_reduce"][0](spark, sf_dir)).split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("HashAggregate") == 2 and "SortAggregate" not in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string,value:double>" in plan
    assert "In(event_type" in plan


def test_years_reach_the_scan(spark, sf_dir):
    plan = _plan(QUERIES["cycle_forcing"][0](spark, sf_dir))
    assert "LessThan(l_shipdate,1998" in plan  # the text of a plan is cut soon after


REDUCTIONS = ["history_instant", "mergeable_reduce", "window_steps", "tape_job", "month_climatology"]


@pytest.mark.parametrize("key", REDUCTIONS)
def test_reductions_hash_without_sorting(spark, sf_dir, key):
    assert "SortAggregate" not in _plan(QUERIES[key][0](spark, sf_dir))
