"""Relations that hold between results, whatever the data."""

from dataclasses import replace
from datetime import date

import pytest
from fixture import rows
from pyspark.sql import functions as F

from streakline.operators import activity, audit, events, profile, quality, retention, streaks
from streakline.plans import customer360 as c360
from streakline.plans.bindings import CAMPAIGN, PERIODS, Tables
from streakline.plans.catalog import catalog

#: Over the whole campaign every user breaks a streak; this shorter one tells them apart.
FIRST_DAYS = replace(CAMPAIGN, end=date(2024, 1, 10))
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, FOLDER)


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: catalog()[name](spark, FOLDER)


@pytest.fixture(scope="module")
def master(t):
    return c360.customer360(
        t.log, t.coupons, t.orders_history_discounts, t.customers, CAMPAIGN, PERIODS
    ).cache()


def test_one_row_per_customer(t, master):
    ids = profile.all_customer_ids([t.log, t.coupons, t.orders_history, t.customers])
    assert master.count() == ids.count() == master.select("unique_customer_id").distinct().count()


def test_joins_do_not_fan_out(run):
    for r in run("join_fanout_check").collect():
        assert r["rows_before"] == r["rows_after"] and r["repeated_keys"] == 0


def test_a_repeated_right_key_is_reported(t):
    base = t.customers.select("unique_customer_id")
    doubled = t.customers.unionByName(t.customers.limit(1))
    got = quality.join_fanout_check(base, {"doubled": doubled}).first()
    assert got["rows_after"] == got["rows_before"] + 1 and got["repeated_keys"] == 1


def test_periods_add_up(master):
    off = master.filter(
        "n_orders_pre + n_orders_during + n_orders_post <> total_orders_all_time"
        " OR abs(total_demand_pre + total_demand_during + total_demand_post"
        " - total_demand_all_time) > 0.001"
    )
    assert off.count() == 0


def test_funnel_does_not_widen(run):
    n = [r["unique_customers"] for r in run("funnel_conversion").collect()]
    assert n == sorted(n, reverse=True)


def test_offset_zero_is_everyone(t):
    lifecycle = retention.retention_lifecycle(t.log, CAMPAIGN)
    for curve in (
        retention.retention_overall(lifecycle),
        retention.cohort_retention(lifecycle),
        retention.retention_by_segment(lifecycle, t.customers),
    ):
        first = curve.filter("days_since_cohort = 0")
        assert {r["retention_rate"] for r in first.collect()} == {100.0}
    participants = retention.cohort_table(t.log, CAMPAIGN).count()
    assert retention.retention_overall(lifecycle).first()["total_users"] == participants


@pytest.mark.parametrize(
    ("name", "column"),
    [
        ("streak_distribution", "percentage"),
        ("opens_distribution", "percentage"),
        ("hourly_distribution", "pct_opens"),
        ("time_buckets", "pct_opens"),
        ("rebuild_segments", "pct"),
    ],
)
def test_shares_sum_to_one_hundred(run, name, column):
    assert run(name).agg(F.sum(column)).first()[0] == pytest.approx(100, abs=0.3)


def test_weekday_shares_sum_within_day_type(run):
    for r in run("weekday_hour_share").groupBy("day_type").agg(F.sum("pct_opens").alias("s")).collect():
        assert r["s"] == pytest.approx(100, abs=0.001)


@pytest.mark.parametrize(
    "segment",
    ["gender", "age", "age_gender", "device", "urban", "platform", "category", "province", "tenure",
     "orders", "streak"],
)
def test_segments_partition_the_participants(t, run, segment):
    total = run(f"segment_{segment}").agg(F.sum("n_participants")).first()[0]
    assert total == c360.participants(t.log, CAMPAIGN).count()


def test_affected_customers_agree(run):
    affected = run("streak_inconsistency").first()["affected_customers"]
    users = run("streak_inconsistent_users").filter("had_inconsistent_streak").count()
    assert affected == users == run("streak_inconsistent_share").first()["affected_customers"]


def test_leakage_once_is_at_most_raw(run):
    leak = run("reward_leakage").first()
    assert 0 < leak["leakage"] <= leak["leakage_raw"]
    assert leak["customers_used"] <= leak["customers_selected"]
    loss = run("potential_loss").first()
    assert 0 < loss["potential_loss"] <= loss["potential_loss_raw"]


def test_rebuild_behaviours_cover_everyone(t):
    flags = streaks.rebuild_flags(activity.activity_bitmaps(t.log, FIRST_DAYS), FIRST_DAYS)
    segments = {r["rebuild_segment"]: r["n"] for r in streaks.rebuild_segments(flags).collect()}
    assert set(segments) <= {streaks.ONE_DAY, streaks.CONTINUOUS, streaks.REBUILT, streaks.DROPPED}
    assert sum(segments.values()) == flags.count()


def test_no_duplicate_customer_days(run):
    assert run("duplicate_keys").count() == 0


def test_selection_totals_count_every_selector(run):
    totals = sum(run("selection_totals").first())
    assert totals == run("down_selection").first()["total_selectors"]


def test_sample_repeats_and_is_independent_of_partitioning(master):
    a = rows(profile.sample_profiles(master, ["n_opens"], 7, seed=1))
    b = rows(profile.sample_profiles(master.repartition(3), ["n_opens"], 7, seed=1))
    c = rows(profile.sample_profiles(master, ["n_opens"], 7, seed=2))
    assert a == b and a != c and len(a) == 7


def test_first_common_customers(t):
    presence = quality.key_presence({"log": t.log, "orders": t.orders_history})
    every = sorted(r[0] for r in quality.common_customers(presence).collect())
    assert [r[0] for r in quality.common_customers(presence, first=10).collect()] == every[:10]


def test_audit_rows_are_customer_days(t):
    days = events.participation_days(t.log, CAMPAIGN).count()
    assert audit.streak_audit(t.log, CAMPAIGN).count() == days
