"""Streaks that survive a missed day, and what they cost in discounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streakline.functions.nulls import flag, mean, money, money_parts, pct, ratio, sum0, sum_money
from streakline.operators.events import campaign_window, is_action, is_participation
from streakline.spec import ID, CampaignSpec


def streak_audit(log: DataFrame, spec: CampaignSpec) -> DataFrame:
    """Logged streak at the last participation of each customer and day."""
    return (
        campaign_window(log, spec)
        .filter(is_participation(spec))
        .groupBy(ID, F.to_date("timestamp").alias("activity_date"))
        .agg(
            F.max_by("current_streak_value", F.struct("timestamp", "event_id", "current_streak_value")).alias(
                "current_streak_value"
            )
        )
    )


def streak_gap_analysis(audit: DataFrame, count_first_as_gap: bool = True) -> DataFrame:
    """Daily streaks with the gap before them and whether the streak outlived it.

    A streak above 1 right after a missed day is inconsistent. A customer's
    first day counts as missed unless ``count_first_as_gap`` is off: a streak
    cannot be above 1 there either.
    """
    by_day = Window.partitionBy(ID).orderBy("activity_date")
    streak = F.col("current_streak_value")
    gap = F.col("days_gap")
    first_counts = F.lit(count_first_as_gap)
    return (
        audit.withColumns(
            {
                "prev_date": F.lag("activity_date").over(by_day),
                "prev_streak": F.lag("current_streak_value").over(by_day),
            }
        )
        .withColumn("days_gap", F.datediff("activity_date", "prev_date"))
        .withColumn("missed_day", F.coalesce(gap > 1, first_counts))
        .withColumns(
            {
                "streak_after_gap": F.when(F.col("missed_day"), streak),
                "inconsistent_streak": F.col("missed_day") & flag(streak > 1),
            }
        )
    )


def customer_inconsistency(gaps: DataFrame) -> DataFrame:
    """Per customer: any missed day, any inconsistent streak, and how many of each."""
    return gaps.groupBy(ID).agg(
        flag(F.bool_or("missed_day")).alias("had_gap"),
        flag(F.bool_or("inconsistent_streak")).alias("had_inconsistent_streak"),
        F.count_if("missed_day").alias("gap_events"),
        F.count_if("inconsistent_streak").alias("inconsistent_events"),
    )


def streak_inconsistency(gaps: DataFrame) -> DataFrame:
    """Missed days, how many kept their streak, and how many customers that touches."""
    customers = customer_inconsistency(gaps)
    return customers.agg(
        sum0(F.col("gap_events")).alias("total_gap_events"),
        sum0(F.col("inconsistent_events")).alias("inconsistent_events"),
        F.round(pct(F.sum("inconsistent_events"), F.sum("gap_events")), 1).alias("pct_inconsistent"),
        F.count_if("had_inconsistent_streak").alias("affected_customers"),
    )


def inconsistent_customer_share(gaps: DataFrame) -> DataFrame:
    """Customers with and without an inconsistent streak, and the affected share."""
    affected, rows = F.count_if("had_inconsistent_streak"), F.count(F.lit(1))
    return customer_inconsistency(gaps).agg(
        F.count_if("had_gap").alias("customers_with_gap"),
        affected.alias("affected_customers"),
        (rows - affected).alias("unaffected_customers"),
        pct(affected, rows).alias("pct_affected"),
    )


def streak_extra_levels(gaps: DataFrame) -> DataFrame:
    """Streak levels kept by mistake: mean and median over inconsistent days."""
    extra = F.col("current_streak_value") - 1
    return gaps.filter("inconsistent_streak").agg(
        mean(extra).alias("avg_extra_levels"), F.median(extra).alias("median_extra")
    )


def affected_selections(log: DataFrame, gaps: DataFrame, spec: CampaignSpec) -> DataFrame:
    """Streak rewards selected by affected customers, one row per customer and code.

    ``n_selected`` keeps how often the code was selected.
    """
    if not spec.code_marker:
        raise ValueError("without a code_marker every code would count as a streak reward")
    affected = gaps.filter("inconsistent_streak").select(ID).distinct()
    return (
        log.filter(
            is_action(spec, spec.selected) & F.col("collectable_value").contains(spec.code_marker)
        )
        .groupBy(ID, F.col("collectable_value").alias("code"))
        .agg(F.count(F.lit(1)).alias("n_selected"))
        .join(affected, ID, "left_semi")
    )


def reward_leakage(selections: DataFrame, transactions: DataFrame) -> DataFrame:
    """Discount that affected customers redeemed on rewards they had selected.

    Orders are summed per customer and code before the join, so it matches one
    row with one row however many orders a customer has. ``leakage`` counts an
    order once. ``leakage_raw`` counts it once per selection of its code, as a
    join with the raw selections would.
    """
    redeemed = (
        transactions.filter((F.col("coupon_discount") > 0) & F.col("coupon_code").isNotNull())
        .groupBy(ID, F.col("coupon_code").alias("code"))
        .agg(sum_money(F.col("coupon_discount")).alias("discount"))
    )
    used = selections.join(redeemed, [ID, "code"], "left")
    parts = money_parts(F.col("discount"))
    per_customer = used.groupBy(ID).agg(
        F.bool_or(F.col("discount").isNotNull()).alias("redeemed"),
        money(parts).alias("once"),
        money(parts * F.col("n_selected")).alias("per_selection"),
    )
    return per_customer.agg(
        F.count(F.lit(1)).alias("customers_selected"),
        F.count_if("redeemed").alias("customers_used"),
        sum_money(F.col("once")).alias("leakage"),
        sum_money(F.col("per_selection")).alias("leakage_raw"),
    )


def potential_loss(selections: DataFrame, tiers: DataFrame) -> DataFrame:
    """Value of all rewards affected customers selected; codes without a value are ignored."""
    values = tiers.select("code", "value")
    valued = selections.join(values, "code", "left")
    return valued.agg(
        sum0(F.col("value")).alias("potential_loss"),
        sum0(F.col("value") * F.col("n_selected")).alias("potential_loss_raw"),
    )


def bug_discount_share(
    leakage: DataFrame, transactions_in_campaign: DataFrame
) -> DataFrame:
    """Redeemed discount of affected customers as a share of all campaign discounts."""
    total = transactions_in_campaign.agg(sum_money(F.col("coupon_discount")).alias("total_discount"))
    return (
        leakage.select("leakage")
        .withColumn("total_discount", total.scalar())
        .withColumn("pct_of_discounts", ratio(F.col("leakage"), F.col("total_discount")) * 100)
    )
