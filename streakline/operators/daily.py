"""Day-level engagement, cards, orders and rewards."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streakline.functions.dates import calendar, in_window, is_weekend, weekday
from streakline.functions.nulls import pct, ratio, sum_money
from streakline.operators.events import is_action, is_participation
from streakline.spec import ID, CampaignSpec

# What counts as a high-value reward day.
HIGH_FLAT_AMOUNT = 5
HIGH_PERCENTAGE = 15


def daily_open_rate(events: DataFrame, spec: CampaignSpec) -> DataFrame:
    """Opens per campaign day as a share of all participants, one row for every day.

    ``pct_change`` compares with the day before and is NULL after a day without
    opens.
    """
    opens = events.filter(is_participation(spec))
    base = opens.agg(F.countDistinct(ID).alias("participants"))
    per_day = opens.groupBy(F.to_date("timestamp").alias("open_date")).agg(
        F.count(F.lit(1)).alias("total_opens"),
        F.countDistinct(ID).alias("unique_opens"),
    )
    days = calendar(events.sparkSession, spec.start, spec.end, "open_date")
    full = days.join(per_day, "open_date", "left").fillna(
        0, ["total_opens", "unique_opens"]
    )

    # one row per campaign day, so a single ordered window is enough
    unique = F.col("unique_opens")
    previous = F.lag("unique_opens").over(Window.orderBy("open_date"))
    return (
        full.withColumns({"participants": base.scalar(), "previous_opens": previous})
        .withColumns(
            {
                "open_rate_pct": F.round(pct(unique, F.col("participants")), 2),
                "campaign_day": F.datediff("open_date", F.lit(spec.start)) + 1,
                "day_of_week": weekday(F.col("open_date")),
                "is_weekend": is_weekend(F.col("open_date")),
                "pct_change": F.when(
                    F.col("previous_opens") > 0,
                    F.round(pct(unique - F.col("previous_opens"), F.col("previous_opens")), 1),
                ),
            }
        )
        .drop("previous_opens")
    )


def open_rate_summary(daily: DataFrame) -> DataFrame:
    """Headline means of the daily open rate and its worst daily change."""
    weekend = F.col("is_weekend")
    rate = F.col("open_rate_pct").cast("decimal(18,2)")

    def mean_rate(condition: Column | None = None) -> Column:
        col = rate if condition is None else F.when(condition, rate)
        return F.round(ratio(F.sum(col), F.count(col)), 1)

    return daily.agg(
        F.max("participants").alias("participants"),
        F.round(ratio(F.sum("unique_opens"), F.count(F.lit(1))), 1).alias("avg_unique_opens"),
        mean_rate().alias("avg_open_rate"),
        mean_rate(~weekend).alias("avg_open_rate_weekday"),
        mean_rate(weekend).alias("avg_open_rate_weekend"),
        F.min("pct_change").alias("largest_drop_pct"),
    )


def largest_drop(daily: DataFrame) -> DataFrame:
    """The day with the largest fall in unique opens; the earliest one on a tie."""
    previous = F.lag("unique_opens").over(Window.orderBy("open_date"))
    return (
        daily.select("open_date", "unique_opens", (F.col("unique_opens") - previous).alias("change"))
        .filter(F.col("change").isNotNull())
        .orderBy("change", "open_date")
        .limit(1)
    )


def card_performance(events: DataFrame, spec: CampaignSpec) -> DataFrame:
    """Customers who opened and who claimed each card type that was opened at all.

    Both counts come from one pass that first reduces the log to customer and
    card type.
    """
    opened = F.coalesce(is_participation(spec), F.lit(False))
    claimed = F.coalesce(is_action(spec, spec.claimed), F.lit(False))
    per_customer = (
        events.filter(F.col("collectable_type").isNotNull() & (opened | claimed))
        .groupBy("collectable_type", ID)
        .agg(F.bool_or(opened).alias("opened"), F.bool_or(claimed).alias("claimed"))
    )
    return (
        per_customer.groupBy("collectable_type")
        .agg(F.count_if("opened").alias("opens"), F.count_if("claimed").alias("claims"))
        .filter(F.col("opens") > 0)
        .withColumn("claim_rate", F.round(pct(F.col("claims"), F.col("opens")), 2))
        .orderBy(F.desc("claim_rate"), "collectable_type")
    )


def best_card(performance: DataFrame) -> DataFrame:
    """The card type with the highest claim rate."""
    return (
        performance.select("collectable_type", "claim_rate")
        .orderBy(F.desc("claim_rate"), "collectable_type")
        .limit(1)
    )


def daily_orders(
    transactions: DataFrame, spec: CampaignSpec, start: date, end: date
) -> DataFrame:
    """Orders, customers and demand per day with orders, from ``start`` to ``end``."""
    day = F.col("order_date")
    return (
        in_window(transactions, "order_local_timestamp", start, end)
        .groupBy(F.to_date("order_local_timestamp").alias("order_date"))
        .agg(
            F.countDistinct(ID).alias("unique_customers"),
            F.count(F.lit(1)).alias("total_orders"),
            sum_money(F.col("demand")).alias("total_demand"),
        )
        .withColumns(
            {
                "day_of_week": weekday(day),
                "is_weekend": is_weekend(day),
                "campaign_period": F.when(day < F.lit(spec.start), "Pre")
                .when(day <= F.lit(spec.end), "During")
                .otherwise("Post"),
            }
        )
    )


def daily_activity(log: DataFrame, spec: CampaignSpec, start: date, end: date) -> DataFrame:
    """Participations and active customers per day, from ``start`` to ``end``."""
    return (
        in_window(log, "timestamp", start, end)
        .filter(is_participation(spec))
        .groupBy(F.to_date("timestamp").alias("day"))
        .agg(
            F.count(F.lit(1)).alias("participate_count"),
            F.countDistinct(ID).alias("unique_active_users"),
        )
    )


def label_rewards(rewards: DataFrame) -> DataFrame:
    """Reward calendar with a discount flag and a display label."""
    has_code = F.col("code").isNotNull()
    return rewards.withColumns(
        {
            "has_discount": (
                (F.col("flat_discount") == 1) | (F.col("percentage_discount") == 1)
            ).cast("int"),
            "reward_label": F.when(
                has_code & (F.col("flat_discount") == 1),
                F.concat_ws(" ", F.lit("€"), F.col("flat_discount_amount").cast("string"), F.lit("off")),
            )
            .when(
                has_code & (F.col("percentage_discount") == 1),
                F.concat_ws(" ", F.col("percentage_rate").cast("string"), F.lit("% extra")),
            )
            .when(F.col("type") == "win", "Big Win!")
            .when(F.col("type") == "tip", "Tip day"),
        }
    )


def reward_response(rewards: DataFrame, activity: DataFrame) -> DataFrame:
    """Labelled reward calendar with the participation each day drew."""
    days = activity.withColumnRenamed("day", "date")
    return (
        label_rewards(rewards)
        .join(days, "date", "left")
        .fillna(0, ["participate_count", "unique_active_users"])
        .orderBy("date")
    )


def daily_full(orders: DataFrame, activity: DataFrame, rewards: DataFrame) -> DataFrame:
    """Days with orders, their participation and their reward.

    All three inputs hold one row per day of a bounded range. ``is_high_value`` is NULL on days without a reward.
    """
    days = activity.withColumnRenamed("day", "order_date")
    gifts = label_rewards(rewards).withColumnRenamed("date", "order_date")
    return (
        orders.join(days, "order_date", "left")
        .join(gifts, "order_date", "left")
        .fillna(0, ["participate_count", "unique_active_users"])
        .fillna("No reward", ["reward_label"])
        .withColumn(
            "is_high_value",
            (F.col("flat_discount_amount") >= HIGH_FLAT_AMOUNT)
            | (F.col("percentage_rate") >= HIGH_PERCENTAGE)
            | (F.col("type") == "win"),
        )
    )


def top_days(full: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` days with the most ordering customers; earlier days first on a tie."""
    return (
        full.select(
            "order_date",
            "unique_customers",
            "total_orders",
            "total_demand",
            "participate_count",
            "unique_active_users",
            "reward_label",
            "is_high_value",
            "day_of_week",
            "is_weekend",
            "campaign_period",
        )
        .orderBy(F.desc("unique_customers"), "order_date")
        .limit(k)
    )


def scale_factor(full: DataFrame) -> DataFrame:
    """Ratio of the two axis maxima of the orders-against-participation chart."""
    return full.agg(
        ratio(F.max("unique_customers"), F.max("unique_active_users")).alias("scale_factor")
    )
