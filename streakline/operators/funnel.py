"""Funnel from entering the app to participating."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streakline.functions.nulls import pct, ratio
from streakline.spec import ID, CampaignSpec


def _stages_reached(events: DataFrame, spec: CampaignSpec) -> DataFrame:
    """One row per customer: which stages the customer has an event of."""
    return events.groupBy(ID).agg(
        F.bool_or(F.col("event") == spec.enter).alias("entered"),
        F.bool_or(F.col("event") == spec.onboard).alias("onboarded"),
        F.bool_or(F.col("event") == spec.participate).alias("participated"),
    )


def funnel_independent(events: DataFrame, spec: CampaignSpec) -> DataFrame:
    """Distinct customers per stage, each stage on its own."""
    return _stages_reached(events, spec).agg(
        F.count(F.lit(1)).alias("total_active_users"),
        F.count_if("entered").alias("entered"),
        F.count_if("onboarded").alias("onboarded"),
        F.count_if("participated").alias("participated"),
    )


def customer_journey(events: DataFrame, spec: CampaignSpec) -> DataFrame:
    """Independent stage counts and each stage as a percentage of the one before."""
    return funnel_independent(events, spec).select(
        "entered",
        "onboarded",
        F.round(pct(F.col("onboarded"), F.col("entered")), 1).alias("onboarded_pct"),
        "participated",
        F.round(pct(F.col("participated"), F.col("onboarded")), 1).alias("participated_pct"),
    )


def funnel_sequential(events: DataFrame, spec: CampaignSpec) -> DataFrame:
    """Customers per stage who are also in every earlier stage, in whatever time order."""
    entered = F.col("entered")
    onboarded = entered & F.col("onboarded")
    counts = _stages_reached(events, spec).agg(
        F.count_if(entered).alias("Entered"),
        F.count_if(onboarded).alias("Onboarded"),
        F.count_if(onboarded & F.col("participated")).alias("Participated"),
    )
    stages = [
        F.struct(F.lit(i).alias("stage_no"), F.lit(c).alias("stage"), F.col(c).alias("unique_customers"))
        for i, c in enumerate(counts.columns, start=1)
    ]
    return counts.select(F.inline(F.array(*stages)))


def funnel_conversion(events: DataFrame, spec: CampaignSpec) -> DataFrame:
    """Sequential funnel with the conversion rate from the stage before."""
    previous = F.lag("unique_customers").over(Window.orderBy("stage_no"))
    return funnel_sequential(events, spec).withColumn(
        "conversion_rate", ratio(F.col("unique_customers"), previous)
    )
