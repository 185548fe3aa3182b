"""Physical plans: pushdown, pruning, and operators that must not appear."""

import re

import pytest

from streakline.operators import audit, events, retention, streaks
from streakline.plans.bindings import CAMPAIGN, Tables
from streakline.plans.catalog import catalog as queries

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning", plan(df)))


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_cross_join_and_no_python_worker(spark, name):
    text = plan(queries()[name](spark, FOLDER))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "MapInArrow"):
        assert operator not in text


def test_window_and_event_reach_the_scan(t):
    text = events.participation_days(t.log, CAMPAIGN)._jdf.queryExecution().toString()
    pushed = re.search(r"PushedFilters: \[(.*)", text).group(1)
    assert "GreaterThanOrEqual(ts,2024-01-05" in pushed
    scan = re.search(r"DataFilters: \[(.*?)Format", text).group(1)
    assert "event_type" in scan


def test_only_needed_columns_are_read(t):
    text = plan(events.participation_days(t.log, CAMPAIGN))
    read = re.search(r"ReadSchema: struct<(.*?)>", text).group(1)
    assert {c.split(":")[0] for c in read.split(",")} == {"ts", "user_id", "event_type"}


def test_segment_reports_do_not_scan_orders(spark):
    text = queries()["segment_gender"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "orders.parquet" not in text and "lineitem.parquet" not in text
    assert "o_totalprice" not in text


def test_shuffles_per_analysis(t):
    assert exchanges(retention.cohort_table(t.log, CAMPAIGN)) == 1
    assert exchanges(audit.streak_audit(t.log, CAMPAIGN)) == 1
    # the days of a customer are one row: gaps, breaks and offsets need no second shuffle
    assert exchanges(retention.retention_lifecycle(t.log, CAMPAIGN)) == 1
    for found in (t.activity, t.lifecycle, streaks.rebuild_flags(t.activity, CAMPAIGN), streaks.streak_gaps(t.activity, CAMPAIGN)):
        assert exchanges(found) == 1
        assert "Window" not in plan(found) and "SortAggregate" not in plan(found)
    assert exchanges(queries()["order_periods"](t.spark, FOLDER)) <= 4
