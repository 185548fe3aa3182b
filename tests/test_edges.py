"""Empty inputs, clock changes and unusual attributes."""

from datetime import date, datetime

import pytest
from fixture import LOG_SCHEMA, PERIODS, SPEC, TXN_SCHEMA, rows
from pyspark.sql import functions as F

from streakline.functions import binning
from streakline.functions.nulls import sum_money
from streakline.operators import activity, audit, daily, events, funnel, impact, profile, quality
from streakline.operators import retention
from streakline.operators import rewards, segments, statistics, streaks, timeofday
from streakline.plans import customer360 as c360
from streakline.sources import schemas
from streakline.sources.cleaning import sanitize_streak, typed_customers
from streakline.sources.readers import reward_days, tier_table
from streakline.spec import ID, scheduled_rewards


@pytest.fixture(scope="module")
def empty(spark):
    log = sanitize_streak(spark.createDataFrame([], LOG_SCHEMA))
    make = lambda ddl: spark.createDataFrame([], " ".join(ddl.split()))
    return {
        "log": log,
        "coupons": make(schemas.COUPONS),
        "txn": make(TXN_SCHEMA),
        "customers": typed_customers(make(schemas.CUSTOMERS)),
        "tiers": tier_table(spark, SPEC.tiers),
        "rewards": reward_days(spark, scheduled_rewards(SPEC.start)),
    }


def test_reports_on_nothing_have_no_rows_or_one_of_nulls(empty):
    e = empty
    camp = events.campaign_window(e["log"], SPEC)
    eng = profile.engagement_summary(camp, SPEC)
    master = c360.customer360(e["log"], e["coupons"], e["txn"], e["customers"], SPEC, PERIODS)
    selection = rewards.reward_selection(e["log"], e["tiers"], SPEC)
    chosen = rewards.selectors(selection, eng)
    with_basket = rewards.selectors_with_basket(chosen, rewards.historic_basket(e["txn"], SPEC.start))
    lifecycle = retention.retention_lifecycle(e["log"], SPEC)
    local = timeofday.local_time_events(camp, SPEC)
    gaps = audit.streak_gap_analysis(audit.streak_audit(e["log"], SPEC))
    days = activity.activity_bitmaps(e["log"], SPEC)
    flags = streaks.rebuild_flags(days, SPEC)
    opens = daily.daily_open_rate(camp, SPEC)
    orders = daily.daily_orders(e["txn"], SPEC, SPEC.start, SPEC.end)
    no_rows = [
        eng,
        master,
        profile.participant_behaviour(master),
        daily.card_performance(camp, SPEC),
        orders,
        daily.daily_full(orders, daily.daily_activity(e["log"], SPEC, SPEC.start, SPEC.end), e["rewards"]),
        streaks.distribution(eng, "max_streak"),
        segments.segment_engagement(eng, {"s": F.col("max_streak")}, with_median=True),
        rewards.basket_by_tier(with_basket),
        rewards.edge_cases(chosen),
        rewards.tier_logged_streak(e["log"], SPEC),
        impact.pre_post_engagement(master),
        retention.cohort_retention(lifecycle),
        retention.retention_by_segment(lifecycle, e["customers"]),
        timeofday.hourly_distribution(local),
        timeofday.weekday_hour_share(local),
        streaks.rebuild_segments(flags),
        gaps,
        quality.day_completeness(e["txn"]),
    ]
    for df in no_rows:
        assert df.count() == 0
    assert rows(funnel.funnel_independent(camp, SPEC)) == [(0, 0, 0, 0)]
    assert [r["conversion_rate"] for r in funnel.funnel_conversion(camp, SPEC).collect()] == [None] * 3
    assert opens.count() == 22 and opens.filter("open_rate_pct IS NOT NULL").count() == 0
    assert rows(daily.largest_drop(opens)) == [(date(2024, 12, 4), 0, 0)]
    assert rows(streaks.streak_stats(eng), "avg_max_streak", "median_max_streak") == [(None, None)]
    assert rows(rewards.selection_vs_streak(chosen)) == [(0, None, None)]
    assert rows(audit.streak_inconsistency(gaps)) == [(0, 0, None, 0)]
    selected = audit.affected_selections(e["log"], gaps, SPEC)
    assert rows(audit.reward_leakage(selected, e["txn"])) == [(0, 0, 0.0, 0.0)]
    assert rows(impact.incremental_impact(impact.period_rates_by_group(master, PERIODS), SPEC)) == [
        (None, None, None)
    ]
    assert statistics.ols(master, "n_orders_during", "max_streak").first()["slope"] is None
    assert rows(statistics.corr_streak_orders(master)) == [(None, None)]
    summary = quality.numeric_summary(master, ["n_opens", "order_uplift_pct"]).collect()
    assert {(r["n"], r["median"]) for r in summary} == {(0, None)}


def test_clock_changes_in_amsterdam(spark):
    utc = [
        datetime(2024, 3, 31, 0, 59),
        datetime(2024, 3, 31, 1, 0),
        datetime(2024, 10, 27, 0, 30),
        datetime(2024, 10, 27, 1, 30),
    ]
    df = spark.createDataFrame(
        [(i, "u", t, "participate") for i, t in enumerate(utc)],
        f"event_id BIGINT, {ID} STRING, timestamp TIMESTAMP_NTZ, event STRING",
    )
    local = timeofday.local_time_events(df, SPEC).orderBy("event_id")
    assert rows(local, "timestamp_local") == [
        (datetime(2024, 3, 31, 1, 59),),
        (datetime(2024, 3, 31, 3, 0),),
        (datetime(2024, 10, 27, 2, 30),),
        (datetime(2024, 10, 27, 2, 30),),
    ]


def test_hours_around_a_clock_change(spark):
    times = [datetime(2024, 3, 30, 23), datetime(2024, 3, 31, 1), datetime(2024, 3, 31, 1, 5),
             datetime(2024, 4, 1, 2), datetime(2024, 4, 2, 2)]
    txn = spark.createDataFrame([(t,) for t in times], "order_local_timestamp TIMESTAMP_NTZ")
    days = [date(2024, 3, 30), date(2024, 3, 31), date(2024, 4, 1)]
    assert rows(quality.hourly_boundary(txn, days)) == [
        (date(2024, 3, 30), 23, 1),
        (date(2024, 3, 31), 1, 2),
        (date(2024, 4, 1), 2, 1),
    ]


def test_results_do_not_depend_on_the_session_time_zone(spark):
    df = spark.createDataFrame(
        [(1, "u", datetime(2024, 12, 3, 23, 30), "participate")],
        f"event_id BIGINT, {ID} STRING, timestamp TIMESTAMP_NTZ, event STRING",
    )
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        local = timeofday.local_time_events(events.campaign_window(df, SPEC), SPEC)
        assert rows(local, "date_local", "hour_local") == [(date(2024, 12, 4), 0)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize(
    ("band", "group", "audit_label"),
    [
        ("15-19", "15-24", "Valid"),
        ("25-29", "25-34", "Valid"),
        ("60-64", "55-64", "Valid"),
        ("65-69", "65+", "Valid"),
        ("95-99", "65+", "Valid"),
        ("10-14", "Unknown", "Valid"),
        ("110-114", "Unknown", "Error (100+)"),
        ("null", "Unknown", "Missing/null"),
        ("unknown", "Unknown", "Valid"),
        (None, "Unknown", "Missing/null"),
    ],
)
def test_age_bands(spark, band, group, audit_label):
    df = spark.createDataFrame([(band,)], "age STRING")
    got = df.select(binning.age_group(F.col("age")), binning.age_audit(F.col("age"))).first()
    assert tuple(got) == (group, audit_label)


def test_streak_bins(spark):
    df = spark.createDataFrame([(v, p) for v in (0, 1, 2, 5, 6, 14, 15, 16, 22) for p in (True, False)],
                               "s INT, p BOOLEAN")
    got = {
        (r["s"], r["p"]): (r["g"], r["e"])
        for r in df.withColumn("g", binning.streak_group(F.col("s")))
        .withColumn("e", binning.engagement_segment(F.col("p"), F.col("s")))
        .collect()
    }
    assert got[0, False] == ("Low engagement", "Non-participants")
    assert got[0, True] == ("Low engagement", None)
    assert got[1, True] == ("One-day users", "One-day users")
    assert got[5, True] == ("Low engagement", "Low engagement")
    assert got[6, True] == ("Medium engagement", "Medium engagement")
    assert got[15, True] == ("Medium engagement", "High engagement (loyal core)")
    assert got[16, True] == ("High engagement", "High engagement (loyal core)")


def test_histogram_bins_are_centred_and_closed_on_the_right(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (2.5,), (2.6,), (7.5,), (7.6,)], "v DOUBLE")
    assert rows(streaks.histogram(df, "v", 5)) == [(0, 3), (5, 2), (10, 1)]


def test_reward_labels(spark):
    labelled = daily.label_rewards(reward_days(spark, scheduled_rewards(SPEC.start)))
    got = {r["date"].day: (r["has_discount"], r["reward_label"], r["code"]) for r in labelled.collect()}
    assert got[3] == (1, "10 % extra", "COUPON3")
    assert got[5] == (0, "Big Win!", "WIN5")
    assert got[7] == (0, "Tip day", "TIP7")
    assert got[8] == (1, "€ 5 off", "COUPON8")
    assert got[19][1] == "20 % extra" and len(got) == 22


def test_period_lengths():
    assert (PERIODS.pre_days, PERIODS.during_days, PERIODS.post_days) == (368, 22, 372)


def test_amounts_under_a_cent_are_summed(spark):
    df = spark.createDataFrame([(0.004,)] * 3, "v DOUBLE")
    assert df.agg(sum_money(F.col("v"))).first()[0] == 0.012
