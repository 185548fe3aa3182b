"""Distinct customers at several levels of time from one aggregation of the events.

Customers get dense numbers inside ranges of the id's hash, and each hour holds the numbers
of its customers as bitmaps of 32,768. Bitmaps merge by OR, so days, hours and the whole
campaign are rolled up from the hours without the customers, and without the events. Every
customer has one place, so the counts are exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streakline.functions.dates import local_time
from streakline.operators.events import is_participation
from streakline.spec import ID, CampaignSpec

#: Customers of a range, about: two bitmaps.
RANGE = 1 << 16
HOURS = ("day", "date_local", "hour_local")


def participation_hours(events: DataFrame, spec: CampaignSpec) -> DataFrame:
    """Participations by customer, UTC day, and local day and hour."""
    local = local_time(F.col("timestamp"), spec.timezone)
    return (
        events.filter(is_participation(spec))
        .groupBy(
            ID,
            F.to_date("timestamp").alias("day"),
            F.to_date(local).alias("date_local"),
            F.hour(local).alias("hour_local"),
        )
        .agg(F.count(F.lit(1)).alias("opens"))
    )


def numbered(hours: DataFrame, customers: int = RANGE) -> DataFrame:
    """The rows with the customer's ``range`` and, from 1 without gaps, ``number`` in it.

    An approximate count of the customers decides how many ranges there are; it only
    balances the work. A customer has at most as many rows as the campaign has hours, so a
    range stays small. Rows without a customer have no number.
    """
    ranges = hours.agg(F.ceil(F.approx_count_distinct(ID) / customers).alias("n")).scalar()
    own = F.pmod(F.xxhash64(ID), F.greatest(ranges, F.lit(1)))
    known = F.col(ID).isNotNull()
    rank = F.dense_rank().over(Window.partitionBy("range").orderBy(F.col(ID).asc_nulls_last()))
    return hours.withColumn("range", own).withColumn("number", F.when(known, rank).cast("bigint"))


def customer_bitmaps(hours: DataFrame, customers: int = RANGE) -> DataFrame:
    """(day, date_local, hour_local, range, bucket): the bitmap of its customers, and opens."""
    return (
        numbered(hours, customers)
        .groupBy(*HOURS, "range", F.bitmap_bucket_number("number").alias("bucket"))
        .agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("customers"),
            F.sum("opens").alias("opens"),
        )
    )


def rolled_up(bitmaps: DataFrame, *keys: str) -> DataFrame:
    """Opens and distinct customers by ``keys``, any of day, date_local and hour_local."""
    merged = bitmaps.groupBy(*keys, "range", "bucket").agg(
        F.bitmap_or_agg("customers").alias("customers"), F.sum("opens").alias("opens")
    )
    return merged.groupBy(*keys).agg(
        F.coalesce(F.sum("opens"), F.lit(0)).alias("opens"),
        F.coalesce(F.sum(F.bitmap_count("customers")), F.lit(0)).alias("customers"),
    )


def participation_levels(bitmaps: DataFrame) -> DataFrame:
    """Opens and distinct customers by UTC day, by local day and hour, by local hour, and in
    all."""
    levels = {"day": ("day",), "local day and hour": HOURS[1:], "local hour": HOURS[2:], "all": ()}
    parts = []
    for name, keys in levels.items():
        day = next((F.col(k) for k in keys if k != "hour_local"), F.lit(None).cast("date"))
        hour = F.col("hour_local") if "hour_local" in keys else F.lit(None).cast("int")
        parts.append(
            rolled_up(bitmaps, *keys).select(
                F.lit(name).alias("level"), day.alias("day"), hour.alias("hour"), "opens", "customers"
            )
        )
    return reduce(DataFrame.unionByName, parts)
