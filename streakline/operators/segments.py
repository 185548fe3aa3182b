"""Engagement of participants per segment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streakline.functions.binning import age_audit, level_rank
from streakline.functions.nulls import mean, pct


def segment_engagement(
    participants: DataFrame,
    segments: Mapping[str, Column],
    digits: int = 1,
    with_median: bool = False,
    levels: Sequence[str] | None = None,
) -> DataFrame:
    """Size, opens, repeat and claim rates and streaks per segment.

    ``segments`` maps output columns to segment expressions, so any customer
    attribute or binning of one works. Rows come largest segment first, or in
    the order of ``levels`` of the first segment column. The median runs over
    streaks, whose few distinct values fit any aggregation buffer.
    """
    rows = F.count(F.lit(1))
    metrics = {
        "avg_opens": mean(F.col("n_opens")),
        "repeat_open_rate": pct(F.count_if(F.col("n_opens") > 1), rows),
        "claim_rate": pct(F.count_if(F.col("n_claims") > 0), rows),
        "avg_max_streak": mean(F.col("max_streak")),
    }
    if with_median:
        metrics["median_max_streak"] = F.median("max_streak")
    out = participants.groupBy(*[c.alias(name) for name, c in segments.items()]).agg(
        rows.alias("n_participants"),
        *[F.round(m, digits).alias(name) for name, m in metrics.items()],
    )
    names = list(segments)
    if levels is None:
        return out.orderBy(F.desc("n_participants"), *names)
    rest = [F.desc(name) for name in names[1:]]
    return out.orderBy(level_rank(F.col(names[0]), levels), *rest)


def age_recode_audit(participants: DataFrame) -> DataFrame:
    """Participants whose age band is missing, out of range or valid."""
    return (
        participants.groupBy(age_audit(F.col("age")).alias("age_valid"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("age_valid")
    )
