"""Day and hour arithmetic on UTC wall-clock timestamps.

Time columns are TIMESTAMP_NTZ holding UTC, so no result depends on the
session time zone.
"""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WEEKEND = (1, 7)  # dayofweek counts from Sunday = 1


def midnight(day: date) -> Column:
    """A plain wall-clock literal that file sources accept in pushed filters."""
    return F.lit(datetime.combine(day, time()).isoformat(sep=" ")).cast("timestamp_ntz")


def in_window(df: DataFrame, ts: str, start: date, end: date) -> DataFrame:
    """Rows whose ``ts`` falls on a day from ``start`` to ``end``, both included.

    Written as a range on the raw column, which is what parquet row-group
    statistics can skip on.
    """
    col = F.col(ts)
    return df.filter((col >= midnight(start)) & (col < midnight(end + timedelta(days=1))))


def before(df: DataFrame, ts: str, day: date) -> DataFrame:
    """Rows strictly before ``day``."""
    return df.filter(F.col(ts) < midnight(day))


def calendar(spark: SparkSession, start: date, end: date, name: str) -> DataFrame:
    """One row per day from ``start`` to ``end``."""
    return spark.range(1).select(
        F.explode(F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 day"))).alias(name)
    )


def local_time(ts: Column, timezone: str) -> Column:
    """UTC wall clock to wall clock in ``timezone``, daylight saving included."""
    return F.convert_timezone(F.lit("UTC"), F.lit(timezone), ts)


def weekday(day: Column) -> Column:
    """Short English weekday name."""
    return F.date_format(day, "E")


def is_weekend(day: Column) -> Column:
    return F.dayofweek(day).isin(*WEEKEND)
