"""The one-row-per-customer table and its narrower relatives.

Every input is reduced to one row per customer before it is joined, so no join
meets a heavy customer's raw rows. The reports take the narrowest table that
answers them: a segment report has no use for the order history and should not
scan it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streakline.operators.events import campaign_window
from streakline.operators.profile import (
    all_customer_ids,
    attach_coupons,
    attach_engagement,
    attach_orders,
    attach_profile,
    coupon_summary,
    engagement_summary,
    order_counts,
    order_periods,
    order_totals,
)
from streakline.spec import ID, CampaignSpec, PeriodSpec


def customer360(
    log: DataFrame,
    coupons: DataFrame,
    transactions: DataFrame,
    customers: DataFrame,
    campaign: CampaignSpec,
    periods: PeriodSpec,
) -> DataFrame:
    """Every customer with attributes, engagement, coupons and order periods.

    Transactions without discount columns give the order periods without
    coupon use.
    """
    base = all_customer_ids([log, coupons, transactions, customers])
    engagement = engagement_summary(campaign_window(log, campaign), campaign)
    with_profile = attach_profile(base, customers)
    with_engagement = attach_engagement(with_profile, engagement)
    with_coupons = attach_coupons(with_engagement, coupon_summary(coupons))
    orders = order_periods if "coupon_discount" in transactions.columns else order_totals
    return attach_orders(with_coupons, orders(transactions, periods))


def engagement_of_all(
    log: DataFrame,
    coupons: DataFrame,
    transactions: DataFrame,
    customers: DataFrame,
    campaign: CampaignSpec,
) -> DataFrame:
    """Every customer with engagement only."""
    base = all_customer_ids([log, coupons, transactions, customers])
    return attach_engagement(base, engagement_summary(campaign_window(log, campaign), campaign))


def orders_of_all(
    log: DataFrame,
    coupons: DataFrame,
    transactions: DataFrame,
    customers: DataFrame,
    campaign: CampaignSpec,
    periods: PeriodSpec,
) -> DataFrame:
    """Every customer with participation, streak and orders per period.

    What the impact reports need of the full table: without attributes,
    coupons and coupon use.
    """
    everyone = engagement_of_all(log, coupons, transactions, customers, campaign)
    slim = everyone.select(ID, "is_participant", "max_streak")
    return attach_orders(slim, order_totals(transactions, periods))


def participants(log: DataFrame, campaign: CampaignSpec) -> DataFrame:
    """Engagement summary of the customers who participated."""
    summary = engagement_summary(campaign_window(log, campaign), campaign)
    return summary.filter("is_participant")


def participant_profile(log: DataFrame, customers: DataFrame, campaign: CampaignSpec) -> DataFrame:
    """Participants with their engagement and attributes, the input of segment reports."""
    slim = participants(log, campaign).select(ID, "n_opens", "n_claims", "max_streak")
    return attach_profile(slim, customers)


def participant_orders(
    log: DataFrame, transactions: DataFrame, campaign: CampaignSpec, periods: PeriodSpec
) -> DataFrame:
    """Participants with their engagement and their orders per period."""
    slim = participants(log, campaign).select(ID, "n_opens", "n_claims", "max_streak")
    return attach_orders(slim, order_counts(transactions, periods))


def selectors_with_orders(
    chosen: DataFrame, transactions: DataFrame, periods: PeriodSpec
) -> DataFrame:
    """Reward selectors with their orders per period."""
    return attach_orders(chosen, order_counts(transactions, periods))


def known_share(master: DataFrame) -> DataFrame:
    """How many customers of the full table were found in the attribute table."""
    return master.groupBy("has_customer_info").agg(F.count(F.lit(1)).alias("n"))
