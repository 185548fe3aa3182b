"""The hand-worked campaign of FIXTURES.md, operator by operator."""

from datetime import date, datetime

import pytest
from fixture import PERIODS, SPEC, log, raw_log, rows, transactions
from pyspark.sql import functions as F

from streakline.operators import activity, audit, daily, events, funnel, profile, retention, rewards, streaks
from streakline.operators import timeofday
from streakline.sources.cleaning import sanitize_streak
from streakline.sources.readers import tier_table
from streakline.spec import ID


@pytest.fixture(scope="module")
def all_events(spark):
    return log(spark).cache()


@pytest.fixture(scope="module")
def camp(all_events):
    return events.campaign_window(all_events, SPEC).cache()


def by_id(df):
    return {r[ID]: r for r in df.collect()}


def test_streaks_are_sanitized(spark):
    clean = by_id(sanitize_streak(raw_log(spark)).filter(f"{ID} = 'u7'"))
    assert clean["u7"]["current_streak_value"] == 0
    kept = sanitize_streak(raw_log(spark)).filter("event_id = 10")
    assert rows(kept, "current_streak_value") == [(5,)]


def test_window_keeps_both_ends(all_events):
    inside = events.campaign_window(all_events, SPEC)
    assert {r["event_id"] for r in inside.collect()} == set(range(1, 23)) - {19, 20}


def test_funnel_independent(camp):
    assert rows(funnel.funnel_independent(camp, SPEC)) == [(6, 3, 3, 5)]


def test_funnel_sequential_and_conversion(camp):
    got = rows(funnel.funnel_conversion(camp, SPEC), "stage", "unique_customers", "conversion_rate")
    assert got[0] == ("Entered", 3, None)
    assert got[1][:2] == ("Onboarded", 2) and got[1][2] == pytest.approx(2 / 3)
    assert got[2] == ("Participated", 2, 1.0)


def test_journey_percentages(camp):
    assert rows(funnel.customer_journey(camp, SPEC)) == [(3, 3, 100.0, 5, 166.7)]


def test_engagement_summary(camp):
    got = by_id(profile.engagement_summary(camp, SPEC))
    assert set(got) == {"u1", "u2", "u3", "u4", "u5", "u7"}
    assert (got["u2"]["max_streak"], got["u2"]["final_streak"]) == (5, 5)
    assert (got["u3"]["max_streak"], got["u3"]["final_streak"]) == (3, 1)
    assert got["u5"]["n_opens"] == 2 and got["u5"]["n_interactions"] == 3
    assert got["u4"]["is_participant"] is False and got["u4"]["first_participate"] is None
    assert got["u1"]["first_participate"] == datetime(2024, 12, 3, 9, 2)


def test_final_streak_tie_is_settled_by_event_id(spark):
    at = datetime(2024, 12, 5, 9)
    tied = spark.createDataFrame(
        [(2, "a", at, "participate", None, 7), (1, "a", at, "participate", None, 3)],
        f"event_id BIGINT, {ID} STRING, timestamp TIMESTAMP_NTZ, event STRING, action STRING,"
        " current_streak_value INT",
    )
    assert rows(profile.engagement_summary(tied, SPEC), "final_streak") == [(7,)]
    assert rows(audit.streak_audit(tied, SPEC), "current_streak_value") == [(7,)]


def test_order_periods(spark):
    got = by_id(profile.order_periods(transactions(spark), PERIODS))
    u2, u3 = got["u2"], got["u3"]
    assert [u2[f"n_orders_{p}"] for p in profile.PERIODS] == [1, 2, 0]
    assert u2["n_coupon_orders_during"] == 2 and u2["order_uplift_pct"] == -100.0
    assert u2["total_demand_during"] == 130 and u2["avg_order_value_during"] == 65.0
    assert u2["avg_order_value_post"] == 0.0
    assert [u3[f"n_orders_{p}"] for p in profile.PERIODS] == [0, 1, 0]
    assert u3["order_uplift_pct"] is None and u3["demand_uplift_pct"] is None


def test_daily_open_rate(camp):
    got = {r["open_date"]: r for r in daily.daily_open_rate(camp, SPEC).collect()}
    assert len(got) == 22
    d = lambda n: got[date(2024, 12, n)]
    assert (d(3)["participants"], d(3)["unique_opens"], d(3)["open_rate_pct"]) == (5, 3, 60.0)
    assert d(3)["pct_change"] is None and d(3)["campaign_day"] == 1
    assert (d(4)["unique_opens"], d(4)["open_rate_pct"], d(4)["pct_change"]) == (2, 40.0, -33.3)
    assert d(8)["unique_opens"] == 0 and d(8)["pct_change"] == -100.0 and d(8)["is_weekend"]
    assert d(9)["unique_opens"] == 1 and d(9)["pct_change"] is None


def test_largest_drop_takes_the_first_of_tied_days(camp):
    opens = daily.daily_open_rate(camp, SPEC)
    assert rows(daily.largest_drop(opens)) == [(date(2024, 12, 4), 2, -1)]


def test_cohorts(all_events):
    sizes = retention.cohort_sizes(retention.cohort_table(all_events, SPEC))
    assert rows(sizes) == [
        (date(2024, 12, 3), 3),
        (date(2024, 12, 4), 1),
        (date(2024, 12, 9), 1),
    ]


def test_overall_retention(all_events):
    lifecycle = retention.retention_lifecycle(all_events, SPEC)
    curve = retention.retention_overall(lifecycle, horizon=14)
    got = {r["days_since_cohort"]: r["retention_rate"] for r in curve.collect()}
    assert got == {0: 100.0, 1: 20.0, 2: 20.0, 3: 20.0, 4: 20.0, 6: 20.0}
    full = retention.retention_overall(lifecycle).collect()
    assert len(full) > len(got) and {r["days_since_cohort"] for r in full} > set(got)


def test_local_time(camp):
    local = by_id(timeofday.local_time_events(camp, SPEC).filter(f"{ID} = 'u5'"))["u5"]
    assert (local["date_local"], local["hour_local"]) == (date(2024, 12, 10), 0)
    buckets = timeofday.time_buckets(timeofday.local_time_events(camp, SPEC))
    assert {r["time_of_day_bucket"]: r["total_opens"] for r in buckets.collect()}["Night (00-05)"] == 1


def test_rebuild(all_events):
    flags = streaks.rebuild_flags(activity.activity_bitmaps(all_events, SPEC), SPEC)
    got = by_id(flags.withColumn("segment", streaks.rebuild_segment()))
    assert got["u1"]["segment"] == streaks.CONTINUOUS
    assert got["u2"]["segment"] == streaks.REBUILT and got["u2"]["first_break_position"] == 2
    assert got["u3"]["segment"] == streaks.DROPPED
    assert (got["u3"]["first_break_position"], got["u3"]["total_active_days"]) == (2, 2)
    assert got["u5"]["segment"] == got["u7"]["segment"] == streaks.ONE_DAY
    assert rows(streaks.rebuild_summary(flags)) == [(5, 2, 1, 2, 1, 20.0)]


def test_streak_audit(all_events):
    gaps = audit.streak_gap_analysis(audit.streak_audit(all_events, SPEC))
    assert rows(audit.streak_inconsistency(gaps)) == [(7, 2, 28.6, 2)]
    affected = gaps.filter("inconsistent_streak").select(ID).distinct()
    assert {r[ID] for r in affected.collect()} == {"u2", "u3"}
    assert rows(audit.streak_extra_levels(gaps)) == [(2.5, 2.5)]


def test_first_day_need_not_count_as_gap(all_events):
    gaps = audit.streak_gap_analysis(audit.streak_audit(all_events, SPEC), count_first_as_gap=False)
    assert rows(audit.streak_inconsistency(gaps), "total_gap_events", "inconsistent_events") == [(2, 1)]


def test_leakage(spark, all_events):
    gaps = audit.streak_gap_analysis(audit.streak_audit(all_events, SPEC))
    selections = audit.affected_selections(all_events, gaps, SPEC)
    leak = audit.reward_leakage(selections, transactions(spark))
    assert rows(leak) == [(1, 1, 10.0, 20.0)]
    assert rows(audit.potential_loss(selections, tier_table(spark, SPEC.tiers))) == [(10, 20)]
    share = audit.bug_discount_share(leak, transactions(spark))
    assert rows(share, "total_discount") == [(15.0,)]


def test_reward_selection_takes_the_first(spark, all_events):
    selection = rewards.reward_selection(all_events, tier_table(spark, SPEC.tiers), SPEC)
    assert rows(selection) == [("u2", "T2", datetime(2024, 12, 22, 10), 10)]
    chosen = rewards.selectors(selection, profile.engagement_summary(all_events, SPEC))
    assert rows(rewards.selection_vs_streak(chosen)) == [(1, 100.0, 100.0)]
    assert rows(rewards.edge_cases(chosen)) == []
    cross = rewards.streak_tier_crosstab(chosen, "max_streak", SPEC)
    assert rows(cross) == [(5, 0, 1, 0, 0, 0)]
    assert rows(rewards.corr_tier_streak(chosen)) == [(None, None)]


def test_unknown_reward_code_has_no_tier(spark, all_events):
    renamed = all_events.withColumn(
        "collectable_value", F.when(F.col("collectable_value").isNotNull(), "OTHER")
    )
    selection = rewards.reward_selection(renamed, tier_table(spark, SPEC.tiers), SPEC)
    assert rows(selection, "selected_tier") == [(None,)]
    none_chosen = rewards.selectors(selection, profile.engagement_summary(all_events, SPEC))
    assert none_chosen.count() == 0
