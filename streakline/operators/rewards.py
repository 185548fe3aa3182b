"""Which streak reward customers select, against the streak they reached."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streakline.functions.association import safe_corr
from streakline.functions.dates import before
from streakline.functions.nulls import mean, mean_of_ratios, pct, ratio, sum0, sum_money
from streakline.functions.quantiles import exact_percentiles
from streakline.operators.events import is_action
from streakline.spec import ID, CampaignSpec


def reward_events(log: DataFrame, spec: CampaignSpec) -> DataFrame:
    """Every reward selection with a code, campaign day or not."""
    return log.filter(is_action(spec, spec.selected) & F.col("collectable_value").isNotNull())


def reward_selection(log: DataFrame, tiers: DataFrame, spec: CampaignSpec) -> DataFrame:
    """Each customer's first selected reward and its tier.

    First means earliest, then lowest event id. It is a minimum per customer
    and not a window, so each task sends one row per customer, however often
    that customer selects.
    """
    first = F.min(F.struct("timestamp", "event_id", "collectable_value")).alias("first")
    chosen = (
        reward_events(log, spec)
        .groupBy(ID)
        .agg(first)
        .select(ID, "first.collectable_value", "first.timestamp")
    )
    codes = tiers.select(F.col("code").alias("collectable_value"), F.col("tier").alias("selected_tier"))
    return chosen.join(codes, "collectable_value", "left").select(
        ID, "collectable_value", "timestamp", "selected_tier"
    )


def tier_mapping(log: DataFrame, tiers: DataFrame, spec: CampaignSpec) -> DataFrame:
    """Reward codes with tier and value, and how often each was selected and by how many."""
    used = (
        reward_events(log, spec)
        .groupBy(F.col("collectable_value").alias("code"))
        .agg(F.count(F.lit(1)).alias("n_selections"), F.countDistinct(ID).alias("n_customers"))
    )
    return (
        tiers.join(used, "code", "left")
        .fillna(0, ["n_selections", "n_customers"])
        .orderBy("code")
    )


def selectors(selection: DataFrame, engagement: DataFrame) -> DataFrame:
    """Customers who selected a known tier, with their streaks.

    A customer without events in the campaign window has streak 0.
    """
    streaks = engagement.select(ID, "max_streak", "final_streak")
    return (
        selection.filter(F.col("selected_tier").isNotNull())
        .select(ID, "selected_tier")
        .join(streaks, ID, "left")
        .fillna(0, ["max_streak", "final_streak"])
    )


def selection_vs_streak(chosen: DataFrame) -> DataFrame:
    """Share of selectors whose tier lies above their final and their highest streak."""
    tier, rows = F.col("selected_tier"), F.count(F.lit(1))
    return chosen.agg(
        rows.alias("total_selectors"),
        pct(F.count_if(tier > F.col("final_streak")), rows).alias("pct_selected_above_final_streak"),
        pct(F.count_if(tier > F.col("max_streak")), rows).alias("pct_selected_above_max_streak"),
    )


def corr_tier_streak(chosen: DataFrame) -> DataFrame:
    """Correlation of the selected tier with the highest and the final streak."""
    tier = F.col("selected_tier")
    return chosen.agg(
        safe_corr(tier, F.col("max_streak")).alias("cor_max"),
        safe_corr(tier, F.col("final_streak")).alias("cor_final"),
    )


def edge_cases(chosen: DataFrame, low_streak: int = 2, high_tier: int = 10) -> DataFrame:
    """Selectors with a low final streak but a high tier."""
    return chosen.filter(
        (F.col("final_streak") <= low_streak) & (F.col("selected_tier") >= high_tier)
    ).select(ID, "max_streak", "final_streak", "selected_tier")


def streak_tier_crosstab(chosen: DataFrame, streak: str, spec: CampaignSpec) -> DataFrame:
    """Selectors per value of the ``streak`` column, one column per tier."""
    tiers = [t.tier for t in spec.tiers]
    wide = chosen.groupBy(streak).pivot("selected_tier", tiers).agg(F.count(F.lit(1)))
    return (
        wide.fillna(0, [str(t) for t in tiers])
        .withColumnsRenamed({str(t): f"tier_{t}" for t in tiers})
        .orderBy(streak)
    )


def selection_totals(crosstab: DataFrame) -> DataFrame:
    """Column sums of a streak-by-tier cross table."""
    tiers = [c for c in crosstab.columns if c.startswith("tier_")]
    return crosstab.agg(*[sum0(F.col(c)).alias(c) for c in tiers])


def tier_logged_streak(log: DataFrame, spec: CampaignSpec) -> DataFrame:
    """Logged streak at the moment of selection, per reward code."""
    streak = F.col("current_streak_value")
    return (
        reward_events(log, spec)
        .groupBy("collectable_value")
        .agg(
            mean(streak).alias("avg_logged_streak"),
            F.median(streak).alias("median_logged_streak"),
            F.min(streak).alias("min_logged_streak"),
            F.max(streak).alias("max_logged_streak"),
            F.count(F.lit(1)).alias("n"),
        )
        .orderBy("avg_logged_streak", "collectable_value")
    )


def down_selection(chosen: DataFrame) -> DataFrame:
    """Share of selectors whose tier lies below, at and above their highest streak."""
    tier, streak, rows = F.col("selected_tier"), F.col("max_streak"), F.count(F.lit(1))
    return chosen.agg(
        rows.alias("total_selectors"),
        pct(F.count_if(tier < streak), rows).alias("pct_down_selected"),
        pct(F.count_if(tier == streak), rows).alias("pct_equal_selected"),
        pct(F.count_if(tier > streak), rows).alias("pct_over_selected"),
    )


def historic_basket(transactions: DataFrame, day: date) -> DataFrame:
    """Orders, demand and mean basket value per customer before ``day``."""
    rows = F.count(F.lit(1))
    return (
        before(transactions, "order_local_timestamp", day)
        .groupBy(ID)
        .agg(
            rows.alias("n_orders_pre"),
            sum_money(F.col("demand")).alias("total_demand_pre"),
            ratio(sum_money(F.col("demand")), rows).alias("historic_abv"),
        )
    )


def selectors_with_basket(chosen: DataFrame, basket: DataFrame) -> DataFrame:
    """Selectors with their basket history; no history leaves it NULL."""
    return chosen.join(basket, ID, "left")


def corr_abv_tier(with_basket: DataFrame) -> DataFrame:
    """Correlation of the historic basket value with the selected tier."""
    return with_basket.agg(
        safe_corr(F.col("historic_abv"), F.col("selected_tier")).alias("cor_abv_tier")
    )


def basket_by_tier(with_basket: DataFrame) -> DataFrame:
    """Basket history of selectors per tier."""
    abv = F.col("historic_abv")
    sizes = with_basket.groupBy("selected_tier").agg(
        F.count(F.lit(1)).alias("n_users"),
        F.count(abv).alias("n_with_history"),
        mean_of_ratios(abv).alias("avg_historic_abv"),
        mean(F.col("n_orders_pre")).alias("avg_orders_pre"),
    )
    medians = exact_percentiles(
        with_basket, ["selected_tier"], abv, {"median_historic_abv": 0.5}
    )
    return sizes.join(medians, "selected_tier", "left").orderBy("selected_tier")


def basket_by_downselect(chosen_with_orders: DataFrame) -> DataFrame:
    """Pre-campaign order value of selectors who took a tier below their streak or not.

    Works on the zero-filled period average, so customers without earlier
    orders count as 0.
    """
    value = F.col("avg_order_value_pre")
    flagged = chosen_with_orders.withColumn(
        "down_selected", F.col("selected_tier") < F.col("max_streak")
    )
    sizes = flagged.groupBy("down_selected").agg(
        F.count(F.lit(1)).alias("n_users"),
        mean_of_ratios(value).alias("avg_historic_abv"),
    )
    medians = exact_percentiles(flagged, ["down_selected"], value, {"median_historic_abv": 0.5})
    return sizes.join(medians, "down_selected", "left").orderBy("down_selected")
