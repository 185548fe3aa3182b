"""Order impact of the campaign: groups, lift, daily rates and increments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streakline.functions.binning import engagement_segment, streak_group
from streakline.functions.nulls import mean, mean_money, mean_of_ratios, pct, ratio
from streakline.spec import CampaignSpec, PeriodSpec

ROWS = "customers"


def impact_participants(master: DataFrame) -> DataFrame:
    """Campaign-period orders and demand of participants against the others."""
    return master.groupBy("is_participant").agg(
        mean(F.col("n_orders_during")).alias("avg_orders_during"),
        mean_money(F.col("total_demand_during")).alias("avg_demand_during"),
        F.count(F.lit(1)).alias("n_customers"),
    )


def streak_impact(master: DataFrame) -> DataFrame:
    """Campaign-period orders and demand per streak group."""
    return master.groupBy(streak_group(F.col("max_streak")).alias("streak_group")).agg(
        mean(F.col("n_orders_during")).alias("avg_orders_during"),
        mean_money(F.col("total_demand_during")).alias("avg_demand_during"),
        F.count(F.lit(1)).alias(ROWS),
    )


def lift_analysis(master: DataFrame) -> DataFrame:
    """Mean change in orders and demand from before to during, per participation.

    Raw totals; ``period_rates_by_group`` allows for the unequal periods.
    """
    return master.groupBy("is_participant").agg(
        mean(F.col("n_orders_during") - F.col("n_orders_pre")).alias("avg_order_lift"),
        mean_money(F.col("total_demand_during") - F.col("total_demand_pre")).alias("avg_demand_lift"),
        F.count(F.lit(1)).alias(ROWS),
    )


def _daily_means(periods: PeriodSpec) -> dict[str, Column]:
    """Aggregates: mean orders and demand per customer and day of each period."""
    days = {"pre": periods.pre_days, "during": periods.during_days, "post": periods.post_days}
    out = {}
    for name, n_days in days.items():
        length = F.lit(float(n_days))
        out[f"avg_orders_per_day_{name}"] = ratio(mean(F.col(f"n_orders_{name}")), length)
        out[f"avg_demand_per_day_{name}"] = ratio(mean_money(F.col(f"total_demand_{name}")), length)
    return out


def period_rates(master: DataFrame, periods: PeriodSpec) -> DataFrame:
    """Mean orders and demand per customer and day, before, during and after."""
    return master.agg(*[c.alias(n) for n, c in _daily_means(periods).items()])


def period_rates_by_group(master: DataFrame, periods: PeriodSpec) -> DataFrame:
    """``period_rates`` of participants and of the others."""
    return master.groupBy("is_participant").agg(
        F.count(F.lit(1)).alias("n_customers"),
        *[c.alias(n) for n, c in _daily_means(periods).items()],
    )


def campaign_lift(master: DataFrame, periods: PeriodSpec) -> DataFrame:
    """Change of the daily order and demand rates from before to during, in percent."""
    rates = period_rates(master, periods)

    def change(metric: str) -> Column:
        pre, during = F.col(f"avg_{metric}_per_day_pre"), F.col(f"avg_{metric}_per_day_during")
        return pct(during - pre, pre)

    return rates.select(
        change("orders").alias("orders_lift_pct"), change("demand").alias("demand_lift_pct")
    )


def _both_groups(rates: DataFrame) -> DataFrame:
    """The participant and the other row of ``period_rates_by_group`` side by side."""
    treated = F.col("is_participant")
    values = [c for c in rates.columns if c != "is_participant"]
    return rates.agg(
        *[F.max(F.when(treated, F.col(c))).alias(f"{c}_treated") for c in values],
        *[F.max(F.when(~treated, F.col(c))).alias(f"{c}_control") for c in values],
    )


def participant_ratio(rates: DataFrame) -> DataFrame:
    """How many times the daily orders and demand of the others participants had."""
    return _both_groups(rates).select(
        *[
            ratio(
                F.col(f"avg_{m}_per_day_during_treated"), F.col(f"avg_{m}_per_day_during_control")
            ).alias(f"{m}_ratio")
            for m in ("orders", "demand")
        ]
    )


def incremental_impact(rates: DataFrame, campaign: CampaignSpec) -> DataFrame:
    """Difference in differences of daily demand, per participant and in total.

    The change of participants from before to during, less the change of the
    others over the same periods, over the days of the campaign.
    """

    def change(group: str) -> Column:
        return F.col(f"avg_demand_per_day_during_{group}") - F.col(f"avg_demand_per_day_pre_{group}")

    days = F.lit(campaign.days)
    return (
        _both_groups(rates)
        .withColumn("incremental_daily_demand", change("treated") - change("control"))
        .select(
            "incremental_daily_demand",
            (F.col("incremental_daily_demand") * days).alias("incremental_per_participant"),
            (F.col("incremental_daily_demand") * days * F.col("n_customers_treated")).alias(
                "total_incremental"
            ),
        )
    )


def _by_engagement(master: DataFrame):
    segment = engagement_segment(F.col("is_participant"), F.col("max_streak"))
    return master.groupBy(segment.alias("engagement_segment"))


def pre_post_engagement(master: DataFrame) -> DataFrame:
    """Orders, demand and order value before and after, per engagement segment."""
    return (
        _by_engagement(master)
        .agg(
            F.count(F.lit(1)).alias("n_users"),
            *[
                agg
                for p in ("pre", "post")
                for agg in (
                    mean(F.col(f"n_orders_{p}")).alias(f"avg_orders_{p}"),
                    mean_money(F.col(f"total_demand_{p}")).alias(f"avg_demand_{p}"),
                    mean_of_ratios(F.col(f"avg_order_value_{p}")).alias(f"avg_aov_{p}"),
                )
            ],
            mean_of_ratios(F.col("order_uplift_pct")).alias("avg_order_uplift_pct"),
            mean_of_ratios(F.col("demand_uplift_pct")).alias("avg_demand_uplift_pct"),
        )
        .orderBy(F.asc_nulls_last("engagement_segment"))
    )


def pre_post_change(master: DataFrame) -> DataFrame:
    """Mean absolute change from before to after, per engagement segment."""

    def change(metric: str) -> Column:
        return F.col(f"{metric}_post") - F.col(f"{metric}_pre")

    return (
        _by_engagement(master)
        .agg(
            F.count(F.lit(1)).alias("n_users"),
            mean(change("n_orders")).alias("orders_change"),
            mean_money(change("total_demand")).alias("demand_change"),
            mean_of_ratios(change("avg_order_value")).alias("aov_change"),
        )
        .orderBy(F.asc_nulls_last("engagement_segment"))
    )
