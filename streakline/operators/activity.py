"""The days of each customer as bits: one row a customer, whatever the number of events.

Gaps, runs, breaks, cohorts and offsets are bit arithmetic on that row, so no window runs
over customers and nothing is shuffled after the one aggregation. Tables of bits of the
same campaign merge by ``bit_or``: a new day's log is added without reading the old ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streakline.functions import bits
from streakline.operators.events import campaign_window, is_participation
from streakline.spec import ID, CampaignSpec


def campaign_day(spec: CampaignSpec, ts: str = "timestamp") -> Column:
    """Days since the first day of the campaign."""
    return F.datediff(F.to_date(ts), F.lit(spec.start))


def day_sets(spec: CampaignSpec, inside: Column | None = None) -> list[Column]:
    """Aggregates: the days a customer participated on, and those of any engagement, over
    events of which ``inside`` marks those in the campaign."""
    within = F.lit(True) if inside is None else inside
    engaged = F.col("event").isin(spec.participate, *spec.interaction)
    day = campaign_day(spec)
    return [
        bits.set_of(F.when(within & is_participation(spec), day), spec.days).alias("participated"),
        bits.set_of(F.when(within & engaged, day), spec.days).alias("engaged"),
    ]


def activity_bitmaps(log: DataFrame, spec: CampaignSpec) -> DataFrame:
    """Customers with engagement: the sets of days ``participated`` and ``engaged``."""
    engaged = F.col("event").isin(spec.participate, *spec.interaction)
    return campaign_window(log, spec).filter(engaged).groupBy(ID).agg(*day_sets(spec))


def merge_bitmaps(tables: list[DataFrame], spec: CampaignSpec) -> DataFrame:
    """One table of the days that any of the tables has."""
    return (
        reduce(DataFrame.unionByName, tables)
        .groupBy(ID)
        .agg(*[bits.union_of(F.col(c), spec.days).alias(c) for c in ("participated", "engaged")])
    )


def days_of(activity: DataFrame, spec: CampaignSpec, which: str) -> DataFrame:
    """(customer, activity_date) of each day in the set ``which``."""
    day = F.explode(bits.members(F.col(which), spec.days)).alias("_day")
    return activity.select(ID, day).select(ID, date_of(F.col("_day"), spec).alias("activity_date"))


def date_of(day: Column, spec: CampaignSpec) -> Column:
    return F.date_add(F.lit(spec.start), day)


def participants(activity: DataFrame, spec: CampaignSpec) -> DataFrame:
    """The rows with a day of participation."""
    return activity.filter(bits.size(bits.words(F.col("participated"), spec.days)) > 0)


def activity_runs(activity: DataFrame, spec: CampaignSpec) -> DataFrame:
    """Runs of consecutive participation days: how many, the longest, the one that the
    campaign ended with (0 days if it had ended before), and the first and last day."""
    days = spec.days
    own = bits.words(F.col("participated"), days)
    as_set = lambda of: F.array(*of)
    found = participants(activity, spec).select(
        ID,
        bits.size(own).alias("active_days"),
        bits.members(as_set(bits.run_starts(own)), days).alias("_starts"),
        bits.members(as_set(bits.run_ends(own)), days).alias("_ends"),
    )
    lengths = F.zip_with("_ends", "_starts", lambda end, start: end - start + 1)
    last = F.element_at("_ends", -1)
    return found.select(
        ID,
        F.col("active_days").cast("bigint").alias("active_days"),
        F.size("_starts").cast("bigint").alias("n_runs"),
        F.array_max(lengths).cast("bigint").alias("longest_run"),
        F.when(last == days - 1, F.element_at(lengths, -1)).otherwise(0).cast("bigint").alias("final_run"),
        date_of(F.element_at("_starts", 1), spec).alias("first_day"),
        date_of(last, spec).alias("last_day"),
    )
