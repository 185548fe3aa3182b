"""When customers participate, in their own local time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streakline.functions.binning import day_part
from streakline.functions.dates import is_weekend, local_time, weekday
from streakline.functions.nulls import pct
from streakline.operators.events import is_participation
from streakline.spec import ID, CampaignSpec


def local_time_events(events: DataFrame, spec: CampaignSpec) -> DataFrame:
    """Participations with local timestamp, hour, day and weekday."""
    return (
        events.filter(is_participation(spec))
        .select(
            ID,
            "event_id",
            "timestamp",
            local_time(F.col("timestamp"), spec.timezone).alias("timestamp_local"),
        )
        .withColumns(
            {
                "hour_local": F.hour("timestamp_local"),
                "date_local": F.to_date("timestamp_local"),
                "weekday_local": weekday(F.col("timestamp_local")),
            }
        )
    )


def _opens(local: DataFrame, *keys) -> DataFrame:
    return local.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_opens"), F.countDistinct(ID).alias("unique_users")
    )


def hourly_distribution(local: DataFrame) -> DataFrame:
    """Opens, customers and share of opens per local hour."""
    total = F.sum("total_opens").over(Window.partitionBy())
    return (
        _opens(local, "hour_local")
        .withColumn("pct_opens", F.round(pct(F.col("total_opens"), total), 2))
        .orderBy("hour_local")
    )


def time_buckets(local: DataFrame) -> DataFrame:
    """Opens, customers and share of opens per part of the day."""
    total = F.sum("total_opens").over(Window.partitionBy())
    return (
        _opens(local, day_part(F.col("hour_local")).alias("time_of_day_bucket"))
        .withColumn("pct_opens", F.round(pct(F.col("total_opens"), total), 1))
        .orderBy(F.desc("total_opens"), "time_of_day_bucket")
    )


def peak_hours(hourly: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` local hours with the most opens; earlier hours first on a tie."""
    return hourly.orderBy(F.desc("total_opens"), "hour_local").limit(k)


def weekday_hour_share(local: DataFrame) -> DataFrame:
    """Share of opens per local hour, within weekdays and within weekends."""
    day_type = F.when(is_weekend(F.col("date_local")), "Weekend").otherwise("Weekday")
    within = F.sum("total_opens").over(Window.partitionBy("day_type"))
    return (
        local.groupBy(day_type.alias("day_type"), "hour_local")
        .agg(F.count(F.lit(1)).alias("total_opens"))
        .withColumn("pct_opens", pct(F.col("total_opens"), within))
        .orderBy("day_type", "hour_local")
    )


def opens_day_hour(local: DataFrame) -> DataFrame:
    """Opens and customers per local day and hour."""
    return (
        _opens(local, "date_local", "hour_local")
        .withColumnRenamed("total_opens", "opens")
        .orderBy("date_local", "hour_local")
    )
