"""Every analysis by name.

An analysis takes the tables of a campaign, builds its plan and returns the
lazy result. Bound to a folder of test tables, it gives doubles with six
decimals, so that results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType

from streakline.functions import binning
from streakline.functions.dates import in_window
from streakline.operators import (
    activity,
    audit,
    daily,
    distinct,
    events,
    funnel,
    impact,
    profile,
    quality,
    retention,
    rewards,
    segments,
    statistics,
    streaks,
    timeofday,
)
from streakline.plans import customer360 as c360
from streakline.plans.bindings import Tables
from streakline.plans.tables import CampaignTables
from streakline.sources import cleaning, readers
from streakline.spec import ID

Analysis = Callable[[CampaignTables], DataFrame]
Query = Callable[[SparkSession, str], DataFrame]
DECIMALS = 6
_REGISTRY: dict[str, Analysis] = {}


def comparable(df: DataFrame) -> DataFrame:
    """Decimals as doubles, and doubles rounded to ``DECIMALS``."""
    out = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, DecimalType):
            out[field.name] = F.col(field.name).cast("double")
        elif isinstance(field.dataType, DoubleType):
            out[field.name] = F.round(F.col(field.name), DECIMALS)
    return df.withColumns(out) if out else df


def query(build: Analysis) -> Analysis:
    """Register ``build`` under its own name."""
    _REGISTRY[build.__name__] = build
    return build


def analyses() -> dict[str, Analysis]:
    """Every analysis as a function of a campaign's tables."""
    return dict(_REGISTRY)


def _bound(build: Analysis) -> Query:
    return lambda spark, folder: comparable(build(Tables(spark, folder)))


def catalog() -> dict[str, Query]:
    """Every analysis bound to the derived campaign of a folder of tables."""
    return {name: _bound(build) for name, build in _REGISTRY.items()}


def _sources(t: CampaignTables) -> dict[str, DataFrame]:
    return {
        "log": t.log,
        "coupons": t.coupons,
        "transactions": t.orders_live,
        "customers": t.customers,
    }


# --- sources and cleaning -------------------------------------------------


@query
def scan_sources(t):
    return quality.scan_summary(_sources(t))


@query
def normalize_headers(t):
    spelled = {
        ID: "Unique Customer ID",
        "gender": "Gender",
        "age": "Age",
        "province": "PROVINCE",
        "orders": "orders",
        "most_used_device": "mostUsedDevice",
        "most_used_platform": "Most-Used Platform",
        "most_popular_category": "most.popular.category",
        "urbanisation": " Urbanisation ",
        "first_order_year": "First Order Year",
    }
    exported = t.raw_customers.withColumn("...12", F.lit(None).cast("string"))
    return cleaning.normalize_headers(exported.withColumnsRenamed(spelled), drop=["x12"])


@query
def null_scrub(t):
    return cleaning.null_scrub(t.raw_log)


@query
def streak_sanitize(t):
    return cleaning.sanitize_streak(t.raw_log).select(ID, "event_id", "current_streak_value")


@query
def id_prefix_strip(t):
    return cleaning.strip_id_prefix(t.raw_customers, t.id_prefix, "bigint").select(ID, "gender", "age")


@query
def campaign_window(t):
    return quality.window_rows(t.log, t.campaign)


@query
def tier_mapping(t):
    return rewards.tier_mapping(t.log, t.tiers, t.campaign)


# --- data quality ---------------------------------------------------------


@query
def hourly_orders(t):
    return quality.hourly_orders(t.orders_live)


@query
def hourly_boundary(t):
    return quality.hourly_boundary(t.orders_live, t.check_days)


@query
def day_completeness(t):
    return quality.day_completeness(t.orders_live)


@query
def time_ranges(t):
    return quality.time_ranges(
        {
            "log": (t.log, "timestamp"),
            "coupons": (t.coupons, "timestamp"),
            "transactions": (t.orders_history, "order_local_timestamp"),
        }
    )


@query
def qualifying_range(t):
    return quality.qualifying_range(t.log, t.campaign)


@query
def daily_events_pivot(t):
    return quality.daily_events_pivot(t.log, t.event_names)


@query
def missing_ids(t):
    return quality.missing_ids(_sources(t))


@query
def id_summary(t):
    return quality.id_summary(_sources(t))


@query
def id_prefix_share(t):
    return quality.id_prefix_share(t.raw_customers, t.id_prefix)


@query
def id_length_dist(t):
    return quality.id_length_distribution({"log": t.log, "customers": t.raw_customers})


def _presence(t):
    return quality.key_presence(
        {
            "log": t.log,
            "coupons": t.coupons,
            "transactions": t.orders_history,
            "customers_raw": t.raw_customers,
            "customers": t.customers,
        }
    )


@query
def key_overlap(t):
    pairs = [
        ("log", "customers_raw"),
        ("log", "transactions"),
        ("coupons", "transactions"),
        ("log", "customers"),
    ]
    return quality.key_overlap(_presence(t), pairs)


def _in_all_logs(t):
    return quality.key_presence(
        {"log": t.log, "coupons": t.coupons, "transactions": t.orders_history}
    )


@query
def common_customers(t):
    return quality.common_customers(_in_all_logs(t))


@query
def customer_timeline(t):
    ids = quality.common_customers(_in_all_logs(t))
    return quality.customer_timeline(ids, t.log, t.coupons, t.orders_history)


@query
def distinct_values(t):
    return quality.distinct_values(t.camp, ["event", "action"])


@query
def freq_table(t):
    return quality.freq_table(t.raw_log, ["current_streak_value", "collectable_value", "action"])


@query
def numeric_summary(t):
    columns = [
        "orders",
        "max_streak",
        "final_streak",
        "n_opens",
        "n_coupons_issued",
        "n_orders_pre",
        "n_orders_post",
        "total_demand_all_time",
        "order_uplift_pct",
    ]
    return quality.numeric_summary(t.master_without_coupon_use, columns)


@query
def non_null_share(t):
    camp = events.campaign_window(cleaning.null_scrub(t.raw_log, ["current_streak_value"]), t.campaign)
    return quality.non_null_share(camp, "current_streak_value", t.campaign)


@query
def duplicate_keys(t):
    return quality.duplicate_keys(
        events.user_daily_activity(t.log, t.campaign), [ID, "activity_date"]
    )


@query
def duplicate_order_days(t):
    dated = t.orders_history.select(ID, F.to_date("order_local_timestamp").alias("order_date"))
    return quality.duplicate_keys(dated, [ID, "order_date"])


@query
def join_fanout_check(t):
    base = t.ids
    return quality.join_fanout_check(
        base,
        {
            "customers": t.customers,
            "engagement": t.engagement,
            "coupons": profile.coupon_summary(t.coupons),
            "orders": profile.order_counts(t.orders_history, t.periods),
        },
    )


@query
def events_per_user(t):
    return quality.events_per_user(events.engagement_events(t.log, t.campaign))


@query
def buyers_count(t):
    return profile.buyers_count(t.everyone)


@query
def tz_compare(t):
    return quality.tz_compare(t.log, "event_id", "timestamp", t.campaign.timezone)


@query
def row_counts(t):
    return quality.row_counts(
        {
            "engagement_summary": t.engagement,
            "coupon_summary": profile.coupon_summary(t.coupons),
            "order_periods": profile.order_counts(t.orders_history, t.periods),
            "reward_selection": t.selection,
            "engagement_events": events.engagement_events(t.log, t.campaign),
            "user_daily_activity": events.user_daily_activity(t.log, t.campaign),
            "participation_days": events.participation_days(t.log, t.campaign),
        }
    )


# --- funnel ---------------------------------------------------------------


@query
def funnel_independent(t):
    return funnel.funnel_independent(t.camp, t.campaign)


@query
def funnel_sequential(t):
    return funnel.funnel_sequential(t.camp, t.campaign)


@query
def funnel_conversion(t):
    return funnel.funnel_conversion(t.camp, t.campaign)


@query
def customer_journey(t):
    return funnel.customer_journey(t.camp, t.campaign)


# --- customer 360 ---------------------------------------------------------


@query
def all_customer_ids(t):
    return t.ids


@query
def engagement_summary(t):
    return t.engagement


@query
def coupon_summary(t):
    return profile.coupon_summary(t.coupons)


@query
def order_periods(t):
    return profile.order_periods(t.orders_history_discounts, t.periods)


@query
def customer360(t):
    return t.master


@query
def customer360_bucketed(t):
    """The same table from per-customer buckets that are written first."""
    return t.store.master


@query
def retention_overall_bucketed(t):
    """Retention from the days in the same buckets."""
    return retention.retention_overall(retention.lifecycle_of(t.store.activity, t.campaign))


@query
def customer_info_match(t):
    base = t.ids
    return c360.known_share(profile.attach_profile(base, t.customers))


@query
def participant_behaviour(t):
    return profile.participant_behaviour(t.everyone)


@query
def sample_profiles(t):
    return profile.sample_profiles(
        t.everyone, ["is_participant", "max_streak", "n_orders_pre", "n_orders_post"], n=10, seed=7
    )


# --- daily engagement and orders -----------------------------------------


def _daily_opens(t):
    return daily.daily_open_rate(t.camp, t.campaign)


@query
def daily_open_rate(t):
    return _daily_opens(t)


@query
def open_rate_summary(t):
    return daily.open_rate_summary(_daily_opens(t))


@query
def largest_drop(t):
    return daily.largest_drop(_daily_opens(t))


@query
def card_performance(t):
    return daily.card_performance(t.camp, t.campaign)


@query
def best_card(t):
    return daily.best_card(daily.card_performance(t.camp, t.campaign))


@query
def daily_orders(t):
    return daily.daily_orders(t.orders_live, t.campaign, *t.order_days)


@query
def daily_activity(t):
    return daily.daily_activity(t.log, t.campaign, *t.order_days)


@query
def reward_calendar(t):
    return daily.reward_response(t.rewards, daily.daily_activity(t.log, t.campaign, *t.order_days))


def _daily_full(t):
    return daily.daily_full(
        daily.daily_orders(t.orders_live, t.campaign, *t.order_days),
        daily.daily_activity(t.log, t.campaign, *t.order_days),
        t.rewards,
    )


@query
def daily_full(t):
    return _daily_full(t)


@query
def top_days(t):
    return daily.top_days(_daily_full(t))


@query
def scale_factor(t):
    return daily.scale_factor(_daily_full(t))


# --- streak levels and card opens ----------------------------------------


@query
def user_max_streak(t):
    return t.max_streaks


@query
def ultimate_streak(t):
    return streaks.ultimate_streak(t.max_streaks, t.campaign)


@query
def long_streak_share(t):
    return streaks.long_streak_share(t.max_streaks, 7)


@query
def streak_distribution(t):
    return streaks.distribution(t.max_streaks, "max_streak")


@query
def streak_stats(t):
    return streaks.streak_stats(t.max_streaks)


@query
def streak_stats_all_customers(t):
    return streaks.streak_stats(t.everyone_engaged).withColumnRenamed(
        "total_participants", "total_customers"
    )


@query
def opens_distribution(t):
    return streaks.distribution(t.participants, "n_opens")


@query
def opens_stats(t):
    return streaks.opens_stats(t.participants)


@query
def histogram_opens(t):
    return streaks.histogram(t.participants, "n_opens", 5)


@query
def histogram_streak(t):
    return streaks.histogram(t.max_streaks, "max_streak", 1)


# --- segmentation ---------------------------------------------------------


@query
def segment_gender(t):
    return segments.segment_engagement(
        t.profiles, {"gender_clean": binning.gender_label(F.col("gender"))}, digits=2
    )


@query
def segment_age(t):
    unknown = "Unknown / Error"
    return segments.segment_engagement(
        t.profiles,
        {"age_group": binning.age_group(F.col("age"), unknown)},
        with_median=True,
        levels=[*binning.AGE_LEVELS, unknown],
    )


@query
def age_recode_audit(t):
    return segments.age_recode_audit(t.profiles)


@query
def segment_age_gender(t):
    return segments.segment_engagement(
        t.profiles,
        {
            "age_group": binning.age_group(F.col("age")),
            "gender_clean": binning.gender_label(F.col("gender")),
        },
        levels=[*binning.AGE_LEVELS, "Unknown"],
    )


def _by_attribute(t, column):
    return segments.segment_engagement(t.profiles, {column: F.col(column)}, with_median=True)


@query
def segment_device(t):
    return _by_attribute(t, "most_used_device")


@query
def segment_urban(t):
    return segments.segment_engagement(
        t.profiles, {"urban_level": binning.urban_level(F.col("urbanisation"))}, with_median=True
    )


@query
def segment_platform(t):
    return _by_attribute(t, "most_used_platform")


@query
def segment_category(t):
    return _by_attribute(t, "most_popular_category")


@query
def segment_province(t):
    return _by_attribute(t, "province")


@query
def segment_tenure(t):
    return segments.segment_engagement(
        t.profiles, {"tenure": binning.tenure(F.col("first_order_year"))}
    )


@query
def segment_orders(t):
    return segments.segment_engagement(
        t.participant_orders, {"order_segment": binning.order_level(F.col("n_orders_pre"))}
    )


@query
def segment_streak(t):
    return segments.segment_engagement(
        t.participants, {"streak_segment": binning.streak_level(F.col("max_streak"))}
    )


# --- reward selection -----------------------------------------------------


@query
def reward_selection(t):
    return t.selection


@query
def selection_vs_streak(t):
    return rewards.selection_vs_streak(t.chosen)


@query
def corr_tier_streak(t):
    return rewards.corr_tier_streak(t.chosen)


@query
def edge_cases(t):
    return rewards.edge_cases(t.chosen)


@query
def crosstab_max_tier(t):
    return rewards.streak_tier_crosstab(t.chosen, "max_streak", t.campaign)


@query
def selection_totals(t):
    return rewards.selection_totals(
        rewards.streak_tier_crosstab(t.chosen, "max_streak", t.campaign)
    )


@query
def crosstab_final_tier(t):
    return rewards.streak_tier_crosstab(t.chosen, "final_streak", t.campaign)


@query
def tier_logged_streak(t):
    return rewards.tier_logged_streak(t.log, t.campaign)


@query
def down_selection(t):
    return rewards.down_selection(t.chosen)


@query
def historic_basket(t):
    return rewards.historic_basket(t.orders_history, t.periods.start)


def _chosen_with_basket(t):
    return rewards.selectors_with_basket(
        t.chosen, rewards.historic_basket(t.orders_history, t.periods.start)
    )


@query
def corr_abv_tier(t):
    return rewards.corr_abv_tier(_chosen_with_basket(t))


@query
def basket_by_tier(t):
    return rewards.basket_by_tier(_chosen_with_basket(t))


@query
def basket_by_downselect(t):
    return rewards.basket_by_downselect(
        c360.selectors_with_orders(t.chosen, t.orders_history, t.periods)
    )


# --- impact ---------------------------------------------------------------


@query
def impact_participants(t):
    return impact.impact_participants(t.everyone)


@query
def corr_streak_orders(t):
    return statistics.corr_streak_orders(t.everyone)


@query
def streak_impact(t):
    return impact.streak_impact(t.everyone)


@query
def lift_analysis(t):
    return impact.lift_analysis(t.everyone)


@query
def ols_streak_orders(t):
    return statistics.ols(t.everyone, "n_orders_during", "max_streak")


@query
def ols_streak_demand(t):
    return statistics.ols(t.everyone, "total_demand_during", "max_streak")


@query
def ols_streak_orders_p_values(t):
    return statistics.ols_p_values(t.everyone, "n_orders_during", "max_streak")


@query
def ols_streak_demand_p_values(t):
    return statistics.ols_p_values(t.everyone, "total_demand_during", "max_streak")


@query
def period_rates(t):
    return impact.period_rates(t.everyone, t.periods)


def _group_rates(t):
    return impact.period_rates_by_group(t.everyone, t.periods)


@query
def period_rates_by_group(t):
    return _group_rates(t)


@query
def campaign_lift(t):
    return impact.campaign_lift(t.everyone, t.periods)


@query
def participant_ratio(t):
    return impact.participant_ratio(_group_rates(t))


@query
def incremental_impact(t):
    return impact.incremental_impact(_group_rates(t), t.campaign)


@query
def pre_post_engagement(t):
    return impact.pre_post_engagement(t.everyone)


@query
def pre_post_change(t):
    return impact.pre_post_change(t.everyone)


@query
def anova_streak_orders(t):
    grouped = t.everyone.withColumn("streak_group", binning.streak_group(F.col("max_streak")))
    return statistics.anova(grouped, "streak_group", "n_orders_during")


@query
def chi_square_participation_buying(t):
    flags = t.everyone.select("is_participant", (F.col("n_orders_during") > 0).alias("bought"))
    return statistics.chi_square(flags, "is_participant", "bought")


# --- retention ------------------------------------------------------------


@query
def engagement_events(t):
    return events.engagement_events(t.log, t.campaign)


@query
def cohort_table(t):
    return retention.cohorts_of(t.activity, t.campaign)


@query
def user_daily_activity(t):
    return events.user_daily_activity(t.log, t.campaign)


@query
def retention_lifecycle(t):
    return t.lifecycle


@query
def cohort_sizes(t):
    return retention.cohort_sizes(retention.cohorts_of(t.activity, t.campaign))


@query
def source_rejects(t):
    """Values of the exports that do not fit their columns' types."""
    return t.reject_counts


@query
def rejected_values(t):
    """Those values, and the customer id of their records."""
    customer = F.get_json_object("record", f"$.{ID}").alias(ID)
    return t.quarantine.select("table", "column", "value", customer)


@query
def export_times(t):
    """Times of the log, spelled with zones or without, as UTC."""
    return t.exports["log"].select("event_id", "timestamp")


@query
def cohort_retention(t):
    return retention.cohort_retention(t.lifecycle, horizon=14)


@query
def cohort_retention_full(t):
    return retention.cohort_retention(t.lifecycle)


@query
def retention_overall(t):
    return retention.retention_overall(t.lifecycle)


@query
def retention_by_segment(t):
    return retention.retention_by_segment(t.lifecycle, t.customers)


# --- time of day ----------------------------------------------------------


@query
def local_time_events(t):
    return t.local


@query
def hourly_distribution(t):
    return timeofday.hourly_distribution(t.local)


@query
def time_buckets(t):
    return timeofday.time_buckets(t.local)


@query
def peak_hours(t):
    return timeofday.peak_hours(timeofday.hourly_distribution(t.local))


@query
def weekday_hour_share(t):
    return timeofday.weekday_hour_share(t.local)


@query
def opens_day_hour(t):
    return timeofday.opens_day_hour(t.local)


@query
def participation_levels(t):
    return distinct.participation_levels(t.participation_bitmaps)


# --- streak rebuilding ----------------------------------------------------


def _flags(t):
    return streaks.rebuild_flags(t.activity, t.campaign)


@query
def streak_gaps(t):
    return streaks.streak_gaps(t.activity, t.campaign)


@query
def rebuild_flags(t):
    return _flags(t)


@query
def rebuild_segments(t):
    return streaks.rebuild_segments(_flags(t))


@query
def rebuild_summary(t):
    return streaks.rebuild_summary(_flags(t))


@query
def activity_runs(t):
    return activity.activity_runs(t.activity, t.campaign)


# --- streak audit and leakage --------------------------------------------


@query
def streak_audit(t):
    return audit.streak_audit(t.log, t.campaign)


@query
def streak_gap_analysis(t):
    return t.gaps


@query
def streak_inconsistency(t):
    return audit.streak_inconsistency(t.gaps)


@query
def streak_inconsistent_users(t):
    return audit.customer_inconsistency(t.gaps)


@query
def streak_inconsistent_share(t):
    return audit.inconsistent_customer_share(t.gaps)


@query
def streak_extra_levels(t):
    return audit.streak_extra_levels(t.gaps)


@query
def reward_leakage(t):
    return audit.reward_leakage(t.affected, t.orders_live)


@query
def potential_loss(t):
    return audit.potential_loss(t.affected, t.tiers)


@query
def bug_discount_share(t):
    in_campaign = in_window(t.orders_live, "order_local_timestamp", t.campaign.start, t.campaign.end)
    return audit.bug_discount_share(
        audit.reward_leakage(t.affected, t.orders_live), in_campaign
    )
