"""One row per customer: engagement, coupons and orders."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streakline.functions.dates import midnight
from streakline.functions.nulls import flag, mean, mean_money, mean_of_ratios, pct, sum_money
from streakline.operators import activity
from streakline.operators.events import is_action, is_participation
from streakline.spec import ID, CampaignSpec, PeriodSpec

PERIODS = ("pre", "during", "post")
ENGAGEMENT_COUNTS = (
    "n_enter",
    "n_onboarded",
    "n_participate",
    "n_opens",
    "n_claims",
    "n_interactions",
    "max_streak",
    "final_streak",
)


def all_customer_ids(tables: Iterable[DataFrame]) -> DataFrame:
    """Every customer id that occurs in any of the tables, once."""
    ids = [t.select(ID).filter(F.col(ID).isNotNull()) for t in tables]
    return reduce(DataFrame.unionByName, ids).distinct()


def engagement_summary(events: DataFrame, spec: CampaignSpec) -> DataFrame:
    """Campaign activity per customer, from the events of the campaign window.

    ``final_streak`` is the streak at the customer's latest event. Opens are
    participations plus opened cards.
    """
    return _with_reached(events.groupBy(ID).agg(*_engagement_aggs(spec, F.lit(True))), spec)


def engagement_of_log(log: DataFrame, spec: CampaignSpec) -> DataFrame:
    """``engagement_summary`` and the campaign days as bits, of every customer of the log.

    One pass over the whole log; a customer without events in the campaign has counts of 0,
    no times and no days.
    """
    ts = F.col("timestamp")
    inside = (ts >= midnight(spec.start)) & (ts < midnight(spec.end + timedelta(days=1)))
    found = log.groupBy(ID).agg(*_engagement_aggs(spec, inside), *activity.day_sets(spec, inside))
    return _with_reached(found, spec)


def _engagement_aggs(spec: CampaignSpec, inside: Column) -> list[Column]:
    participated = inside & is_participation(spec)
    opened = inside & is_action(spec, spec.opened)
    streak, ts = F.col("current_streak_value"), F.col("timestamp")
    within = lambda col: F.when(inside, col)
    latest = F.struct("timestamp", "event_id", "current_streak_value")
    return [
        F.count_if(inside & (F.col("event") == spec.enter)).alias("n_enter"),
        F.count_if(inside & (F.col("event") == spec.onboard)).alias("n_onboarded"),
        F.count_if(participated).alias("n_participate"),
        F.count_if(participated | opened).alias("n_opens"),
        F.count_if(inside & is_action(spec, spec.claimed)).alias("n_claims"),
        F.count_if(inside).alias("n_interactions"),
        F.max(within(streak)).alias("max_streak"),
        F.max_by(streak, within(latest)).alias("final_streak"),
        F.min(within(ts)).alias("first_engagement"),
        F.max(within(ts)).alias("last_engagement"),
        F.min(F.when(participated, ts)).alias("first_participate"),
    ]


def _with_reached(engagement: DataFrame, spec: CampaignSpec) -> DataFrame:
    return engagement.withColumns(
        {
            "is_participant": F.col("n_participate") > 0,
            "reached_ultimate_streak": F.col("max_streak") == spec.ultimate_streak,
        }
    )


def coupon_summary(coupons: DataFrame) -> DataFrame:
    """Coupons issued per customer, over the whole coupon log."""
    return coupons.groupBy(ID).agg(
        F.count(F.lit(1)).alias("n_coupons_issued"),
        sum_money(F.col("value")).alias("total_coupon_value"),
        mean_money(F.col("value")).alias("avg_coupon_value"),
        F.count_if(F.col("value_type") == "Percentage").alias("n_percentage"),
        F.count_if(F.col("value_type") == "Fixed").alias("n_fixed"),
        F.min("timestamp").alias("first_coupon_date"),
        F.max("timestamp").alias("last_coupon_date"),
        F.lit(True).alias("has_coupon"),
    )


def _period(periods: PeriodSpec) -> dict[str, Column]:
    ts = F.col("order_local_timestamp")
    start = ts < midnight(periods.start)
    end = F.to_date(ts) <= F.lit(periods.end)
    return {"pre": start, "during": ~start & end, "post": ~end}


def order_counts(transactions: DataFrame, periods: PeriodSpec) -> DataFrame:
    """Orders and demand per customer before, during and after the campaign.

    The period columns are conditional aggregates, so the wide row needs one
    shuffle by customer. A customer without orders in a period has 0 there.
    """
    return _by_period(transactions, periods, _order_aggs)


def order_periods(transactions: DataFrame, periods: PeriodSpec) -> DataFrame:
    """``order_counts`` with coupon use, all-time totals and post-over-pre uplift.

    Uplift is NULL for a customer without a pre-campaign baseline.
    """
    return with_uplift(
        _by_period(transactions, periods, lambda p, c: _order_aggs(p, c) + _coupon_aggs(p, c))
    )


def order_totals(transactions: DataFrame, periods: PeriodSpec) -> DataFrame:
    """``order_periods`` without coupon use, for transactions without discounts."""
    return with_uplift(order_counts(transactions, periods))


def orders_by_customer(transactions: DataFrame, periods: PeriodSpec) -> DataFrame:
    """``order_periods``, or ``order_totals`` without discounts, of every customer of the
    transactions; orders without a time count in no period."""
    used = "coupon_discount" in transactions.columns
    aggs = (lambda p, c: _order_aggs(p, c) + _coupon_aggs(p, c)) if used else _order_aggs
    return with_uplift(_summed(transactions, periods, aggs))


def _by_period(transactions: DataFrame, periods: PeriodSpec, aggs) -> DataFrame:
    return _summed(transactions.filter(F.col("order_local_timestamp").isNotNull()), periods, aggs)


def _summed(transactions: DataFrame, periods: PeriodSpec, aggs) -> DataFrame:
    return transactions.groupBy(ID).agg(
        *[a for name, inside in _period(periods).items() for a in aggs(name, inside)]
    )


def _order_aggs(period: str, inside: Column) -> list[Column]:
    demand = F.when(inside, F.col("demand"))
    return [
        F.count_if(inside).alias(f"n_orders_{period}"),
        sum_money(demand).alias(f"total_demand_{period}"),
        F.coalesce(mean_money(demand), F.lit(0.0)).alias(f"avg_order_value_{period}"),
    ]


def _coupon_aggs(period: str, inside: Column) -> list[Column]:
    discount = F.col("coupon_discount")
    with_coupon = flag(discount > 0) | F.col("coupon_code").isNotNull()
    return [
        F.count_if(inside & with_coupon).alias(f"n_coupon_orders_{period}"),
        sum_money(F.when(inside, discount)).alias(f"total_coupon_discount_{period}"),
    ]


def with_uplift(wide: DataFrame) -> DataFrame:
    """All-time totals and post-over-pre uplift percentages of a wide period table."""

    def total(metric: str) -> Column:
        return sum((F.col(f"{metric}_{p}") for p in PERIODS[1:]), F.col(f"{metric}_{PERIODS[0]}"))

    def uplift(metric: str) -> Column:
        pre, post = F.col(f"{metric}_pre"), F.col(f"{metric}_post")
        return F.when(pre > 0, pct(post - pre, pre))

    return wide.withColumns(
        {
            "total_orders_all_time": total("n_orders"),
            "total_demand_all_time": total("total_demand"),
            "order_uplift_pct": uplift("n_orders"),
            "demand_uplift_pct": uplift("total_demand"),
        }
    )


def attach_profile(base: DataFrame, customers: DataFrame) -> DataFrame:
    """Customer attributes, and whether the customer was found at all."""
    return base.join(customers, ID, "left").withColumn(
        "has_customer_info", F.col("gender").isNotNull()
    )


def attach_engagement(base: DataFrame, engagement: DataFrame) -> DataFrame:
    """Engagement summary; customers without campaign events get zeros and false flags."""
    joined = base.join(engagement, ID, "left")
    return joined.fillna(0, list(ENGAGEMENT_COUNTS)).fillna(
        False, ["is_participant", "reached_ultimate_streak"]
    )


def attach_coupons(base: DataFrame, coupons: DataFrame) -> DataFrame:
    """Coupon summary; customers without coupons get zeros and no dates."""
    joined = base.join(coupons, ID, "left")
    return _zero_fill(
        joined, ["n_coupons_issued", "total_coupon_value", "avg_coupon_value", "n_percentage", "n_fixed"]
    ).fillna(False, ["has_coupon"])


def attach_orders(base: DataFrame, orders: DataFrame) -> DataFrame:
    """Order periods; customers without orders get zeros, their uplift stays NULL."""
    counted = [c for c in orders.columns if c != ID and not c.endswith("_uplift_pct")]
    return _zero_fill(base.join(orders, ID, "left"), counted)


def _zero_fill(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in columns})


def participant_behaviour(master: DataFrame) -> DataFrame:
    """Orders per period and mean uplift of participants against the others."""
    return master.groupBy("is_participant").agg(
        F.count(F.lit(1)).alias("n_customers"),
        *[mean(F.col(f"n_orders_{p}")).alias(f"avg_orders_{p}") for p in PERIODS],
        mean_of_ratios(F.col("order_uplift_pct")).alias("avg_uplift_pct"),
    )


def buyers_count(master: DataFrame) -> DataFrame:
    """Customers with at least one order at any time."""
    return master.agg(
        F.count(F.lit(1)).alias("n_customers"),
        F.count_if(F.col("total_orders_all_time") > 0).alias("n_buyers"),
    )


def sample_profiles(master: DataFrame, columns: Iterable[str], n: int, seed: int) -> DataFrame:
    """``n`` customers drawn at random; the same seed draws the same customers.

    The draw orders customers by a hash of seed and id, so it does not depend
    on how the data is partitioned, and runs as a distributed top-n.
    """
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(ID).cast("string")))
    return master.select(ID, *columns).orderBy(draw, ID).limit(n)
