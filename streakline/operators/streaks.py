"""Streak levels, card opens and streak rebuilding.

Streaks and day counts are bounded by the length of the campaign, so the
histograms and the one-partition windows over them stay small at any scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streakline.functions import bits
from streakline.functions.binning import bin_centre
from streakline.functions.nulls import flag, pct, ratio
from streakline.operators.activity import date_of, participants
from streakline.operators.events import is_participation
from streakline.spec import ID, CampaignSpec

# Names of the rebuild behaviours.
ONE_DAY = "One-Day Users (No Streak)"
CONTINUOUS = "Continuous Users (No Breaks)"
REBUILT = "Tried to Rebuild Streak"
DROPPED = "Broke & Dropped Off"


def user_max_streak(events: DataFrame, spec: CampaignSpec) -> DataFrame:
    """Highest logged streak of every participant, over all of their events."""
    return (
        events.groupBy(ID)
        .agg(
            F.max("current_streak_value").alias("max_streak"),
            F.bool_or(is_participation(spec)).alias("_participant"),
        )
        .filter("_participant")
        .select(ID, F.coalesce("max_streak", F.lit(0)).alias("max_streak"))
    )


def ultimate_streak(streaks: DataFrame, spec: CampaignSpec) -> DataFrame:
    """Participants who reached the full streak, as count and percentage."""
    reached = F.count_if(F.col("max_streak") == spec.ultimate_streak)
    return streaks.agg(
        F.count(F.lit(1)).alias("total_participants"),
        reached.alias("ultimate_users"),
        F.round(pct(reached, F.count(F.lit(1))), 2).alias("pct_ultimate"),
    )


def long_streak_share(streaks: DataFrame, at_least: int) -> DataFrame:
    """Participants whose streak got to ``at_least`` days, as count and percentage."""
    long = F.count_if(F.col("max_streak") >= at_least)
    return streaks.agg(
        F.count(F.lit(1)).alias("total_participants"),
        long.alias("long_streak_users"),
        F.round(pct(long, F.count(F.lit(1))), 2).alias("pct_long_streak"),
    )


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows per value of ``column`` and their percentage of all rows."""
    total = F.sum("n").over(Window.partitionBy())
    return (
        df.groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("percentage", pct(F.col("n"), total))
        .orderBy(column)
    )


def streak_stats(streaks: DataFrame) -> DataFrame:
    """Most common, mean and median streak, worked out on the streak histogram.

    On a tie the most common streak is the shorter one.
    """
    histogram = streaks.groupBy("max_streak").agg(F.count(F.lit(1)).alias("n"))
    n, streak = F.col("n"), F.col("max_streak")
    return histogram.agg(
        F.sum("n").alias("total_participants"),
        F.max_by("max_streak", F.struct(n, -streak)).alias("most_common_streak"),
        F.max("n").alias("most_common_n"),
        ratio(F.sum(n * streak), F.sum("n")).alias("avg_max_streak"),
        F.percentile(streak, 0.5, n).alias("median_max_streak"),
    )


def opens_stats(participants: DataFrame) -> DataFrame:
    """Minimum, median, mean and maximum of cards opened, on their histogram."""
    histogram = participants.groupBy("n_opens").agg(F.count(F.lit(1)).alias("n"))
    n, opens = F.col("n"), F.col("n_opens")
    return histogram.agg(
        F.min("n_opens").alias("min_opens"),
        F.percentile(opens, 0.5, n).alias("median_opens"),
        ratio(F.sum(n * opens), F.sum("n")).alias("mean_opens"),
        F.max("n_opens").alias("max_opens"),
    )


def histogram(df: DataFrame, column: str, width: int) -> DataFrame:
    """Rows per bin of ``width``, bins centred on multiples of the width."""
    return (
        df.groupBy(bin_centre(F.col(column), width).alias("bin_centre"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("bin_centre")
    )


def streak_gaps(activity: DataFrame, spec: CampaignSpec) -> DataFrame:
    """Participation days with the gap in days to the customer's previous one.

    ``activity`` holds the customers' days as bits; the day before is the entry before in
    the customer's own array, so there is no window.
    """
    days = bits.members(F.col("participated"), spec.days)
    pairs = F.transform("_days", lambda d, i: F.struct(d.alias("day"), F.get("_days", i - 1).alias("previous")))
    return (
        activity.select(ID, days.alias("_days"))
        .select(ID, F.inline(pairs))
        .select(
            ID,
            date_of(F.col("day"), spec).alias("activity_date"),
            date_of(F.col("previous"), spec).alias("prev_date"),
            (F.col("day") - F.col("previous")).alias("gap_days"),
        )
    )


def rebuild_flags(activity: DataFrame, spec: CampaignSpec) -> DataFrame:
    """Active days, breaks and whether a customer came back after the first break.

    ``first_break_position`` is the place, among the active days, of the day
    after the first gap. Only a customer with further days after that one
    counts as rebuilding. A break is a run of days after the first one.
    """
    days = bits.words(F.col("participated"), spec.days)
    starts = bits.run_starts(days)
    per_customer = participants(activity, spec).select(
        ID,
        bits.size(days).cast("bigint").alias("total_active_days"),
        (bits.size(starts) - 1).cast("bigint").alias("n_breaks"),
        (bits.size_below(days, bits.without_first(starts)) + 1).cast("int").alias("first_break_position"),
    )
    return per_customer.withColumns(
        {
            "had_streak_break": F.col("n_breaks") > 0,
            "tried_to_rebuild": flag(F.col("first_break_position") < F.col("total_active_days")),
        }
    )


def rebuild_segment() -> Column:
    return (
        F.when(F.col("total_active_days") == 1, ONE_DAY)
        .when(F.col("n_breaks") == 0, CONTINUOUS)
        .when(F.col("tried_to_rebuild"), REBUILT)
        .otherwise(DROPPED)
    )


def rebuild_segments(flags: DataFrame) -> DataFrame:
    """Participants per rebuild behaviour, as count and percentage."""
    total = F.sum("n").over(Window.partitionBy())
    return (
        flags.groupBy(rebuild_segment().alias("rebuild_segment"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("pct", F.round(pct(F.col("n"), total), 1))
        .orderBy(F.desc("n"), "rebuild_segment")
    )


def rebuild_summary(flags: DataFrame) -> DataFrame:
    """Headline counts of the rebuild behaviours."""
    segment = rebuild_segment()
    tried = F.count_if("tried_to_rebuild")
    return flags.agg(
        F.count(F.lit(1)).alias("total_participants"),
        F.count_if(segment == ONE_DAY).alias("one_day_users"),
        F.count_if(segment == CONTINUOUS).alias("continuous_users"),
        F.count_if(F.col("n_breaks") > 0).alias("users_broke_streak"),
        tried.alias("users_tried_rebuild"),
        F.round(pct(tried, F.count(F.lit(1))), 2).alias("pct_tried_rebuild"),
    )
