"""Cohort retention after the first participation.

The log is first reduced to one row a customer, with the days as bits. Cohort and offsets
come from that row, so the heaviest user costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streakline.functions import bits
from streakline.functions.binning import listed_age_group
from streakline.functions.nulls import pct
from streakline.operators.activity import activity_bitmaps, date_of, participants
from streakline.spec import ID, CampaignSpec


def cohort_table(log: DataFrame, spec: CampaignSpec) -> DataFrame:
    """Each participant's cohort: the day of the first participation."""
    return cohorts_of(activity_bitmaps(log, spec), spec)


def cohorts_of(activity: DataFrame, spec: CampaignSpec) -> DataFrame:
    """``cohort_table`` from the customers' days."""
    first = bits.first(bits.words(F.col("participated"), spec.days))
    return participants(activity, spec).select(ID, date_of(first, spec).alias("cohort_date"))


def cohort_sizes(cohorts: DataFrame) -> DataFrame:
    return (
        cohorts.groupBy("cohort_date")
        .agg(F.count(F.lit(1)).alias("cohort_size"))
        .orderBy("cohort_date")
    )


def retention_lifecycle(log: DataFrame, spec: CampaignSpec) -> DataFrame:
    """Engaged days of participants, as days since the first participation.

    Days before the first participation and customers who never participated
    are left out.
    """
    return lifecycle_of(activity_bitmaps(log, spec), spec)


def lifecycle_of(activity: DataFrame, spec: CampaignSpec) -> DataFrame:
    """``retention_lifecycle`` from the customers' days."""
    first = bits.first(bits.words(F.col("participated"), spec.days))
    engaged = F.explode(bits.members(F.col("engaged"), spec.days)).alias("_day")
    rows = participants(activity, spec).select(ID, first.alias("_first"), engaged)
    return rows.filter("_day >= _first").select(
        ID,
        date_of(F.col("_day"), spec).alias("activity_date"),
        date_of(F.col("_first"), spec).alias("cohort_date"),
        (F.col("_day") - F.col("_first")).alias("days_since_cohort"),
    )


def _curve(lifecycle: DataFrame, keys: list[str], horizon: int | None, size: str) -> DataFrame:
    """Active customers per key and day offset, against those active at offset 0.

    A participant is active on the cohort day by definition, so the count at
    offset 0 is the cohort size and no second table is needed. Lifecycle rows
    are distinct per customer and day: a plain count is a count of customers.
    ``horizon`` is the last offset, by default the last there is.
    """
    active = lifecycle.groupBy(*keys, "days_since_cohort").agg(F.count(F.lit(1)).alias("active_users"))
    at_start = F.max(F.when(F.col("days_since_cohort") == 0, F.col("active_users")))
    curve = active.withColumn(size, at_start.over(Window.partitionBy(*keys)))
    if horizon is not None:
        curve = curve.filter(F.col("days_since_cohort") <= horizon)
    return curve.withColumn("retention_rate", pct(F.col("active_users"), F.col(size))).orderBy(
        *keys, "days_since_cohort"
    )


def retention_overall(lifecycle: DataFrame, horizon: int | None = None) -> DataFrame:
    """Share of all participants active per day offset.

    The offset is counted per customer from the own cohort day, so offset 0
    holds every participant once.
    """
    return _curve(lifecycle, [], horizon, "total_users")


def cohort_retention(lifecycle: DataFrame, horizon: int | None = None) -> DataFrame:
    """Share of each cohort active per day offset."""
    return _curve(lifecycle, ["cohort_date"], horizon, "cohort_size")


def demographics(customers: DataFrame) -> DataFrame:
    """Customers with a known gender and age group, by the exact codes and bands."""
    return customers.select(
        ID,
        F.when(F.col("gender") == "V", "Female").when(F.col("gender") == "M", "Male").alias("gender_clean"),
        listed_age_group(F.col("age")).alias("age_group_clean"),
    ).dropna(subset=["gender_clean", "age_group_clean"])


def retention_by_segment(
    lifecycle: DataFrame, customers: DataFrame, horizon: int | None = None
) -> DataFrame:
    """Retention per gender and age group, over customers with both known."""
    known = lifecycle.join(demographics(customers), ID, "inner")
    return _curve(known, ["gender_clean", "age_group_clean"], horizon, "cohort_size")

