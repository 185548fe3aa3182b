"""Bins that turn customer attributes into report segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes, bounds and labels of the report segments. Bounds are the
# highest value of each bin; the last label is open-ended.
FEMALE = ("V", "v", "Vrouw")
MALE = ("M", "m", "Man")
AGE_RANGE = (15, 99)
AGE_BOUNDS = (24, 34, 44, 54, 64)
AGE_LEVELS = ("15-24", "25-34", "35-44", "45-54", "55-64", "65+")
URBAN_BOUNDS = (2, 3)
URBAN_LEVELS = ("Low (rural/suburban)", "Medium", "High (urban)")
TENURE_BOUNDS = (2015, 2022)
TENURE_LEVELS = ("Legacy Loyalists (≤2015)", "Established (2016-2022)", "New (2023-2024)")
ORDER_BOUNDS = (1, 5)
ORDER_LEVELS = ("Low (0-1)", "Medium (2-5)", "High (6+)")
STREAK_BOUNDS = (1, 5)
STREAK_LEVELS = ("Low (1 day)", "Medium (2-5 days)", "High (6+ days)")
GROUP_BOUNDS = (5, 15)
GROUP_LEVELS = ("Low engagement", "Medium engagement", "High engagement")
SEGMENT_BOUNDS = (1, 5, 14)
SEGMENT_LEVELS = (
    "One-day users",
    "Low engagement",
    "Medium engagement",
    "High engagement (loyal core)",
)
HOUR_BOUNDS = (5, 11, 17)
HOUR_LEVELS = ("Night (00-05)", "Morning (06-11)", "Afternoon (12-17)", "Evening (18-23)")


def upper_bins(value: Column, bounds: Sequence[int], labels: Sequence[str]) -> Column:
    """Label by the first bound that ``value`` does not exceed; the last label is the rest.

    A NULL value gets NULL, never the open-ended last label.
    """
    out = F.when(value.isNull(), F.lit(None))
    for bound, label in zip(bounds, labels):
        out = out.when(value <= bound, label)
    return out.otherwise(labels[-1])


def gender_label(gender: Column, other: str = "Unknown") -> Column:
    return F.when(gender.isin(*FEMALE), "Female").when(gender.isin(*MALE), "Male").otherwise(other)


def age_lower(band: Column) -> Column:
    """Lower end of a text age band; NULL when the text does not start with digits."""
    return F.nullif(F.regexp_extract(band, r"^(\d+)", 1), F.lit("")).try_cast("int")


def age_group(band: Column, unknown: str = "Unknown") -> Column:
    """Report age group; bands out of range and unreadable ones are ``unknown``."""
    low = age_lower(band)
    return F.when(low.between(*AGE_RANGE), upper_bins(low, AGE_BOUNDS, AGE_LEVELS)).otherwise(unknown)


def listed_age_group(band: Column) -> Column:
    """Report age group of a five-year band, 15-19 to 95-99; NULL for any other text."""
    bands = [f"{low}-{low + 4}" for low in range(AGE_RANGE[0], AGE_RANGE[1], 5)]
    return F.when(band.isin(bands), upper_bins(age_lower(band), AGE_BOUNDS, AGE_LEVELS))


def age_audit(band: Column) -> Column:
    """Why a band does or does not fall in an age group."""
    return (
        F.when(band.isNull() | band.isin("null", "NA"), "Missing/null")
        .when(age_lower(band) >= 100, "Error (100+)")
        .otherwise("Valid")
    )


def urban_level(urbanisation: Column) -> Column:
    return F.coalesce(upper_bins(urbanisation, URBAN_BOUNDS, URBAN_LEVELS), F.lit("Unknown"))


def tenure(first_order_year: Column) -> Column:
    return F.coalesce(upper_bins(first_order_year, TENURE_BOUNDS, TENURE_LEVELS), F.lit("Unknown"))


def order_level(n_orders: Column) -> Column:
    return upper_bins(n_orders, ORDER_BOUNDS, ORDER_LEVELS)


def streak_level(max_streak: Column) -> Column:
    return upper_bins(max_streak, STREAK_BOUNDS, STREAK_LEVELS)


def streak_group(max_streak: Column) -> Column:
    """Engagement group of any customer; a streak of 0 counts as low engagement."""
    return F.when(max_streak == 1, "One-day users").otherwise(
        upper_bins(max_streak, GROUP_BOUNDS, GROUP_LEVELS)
    )


def engagement_segment(is_participant: Column, max_streak: Column) -> Column:
    """Engagement segment; NULL for a participant whose logged streak never reached 1."""
    return F.when(~is_participant, "Non-participants").when(
        max_streak >= 1, upper_bins(max_streak, SEGMENT_BOUNDS, SEGMENT_LEVELS)
    )


def day_part(hour: Column) -> Column:
    return upper_bins(hour, HOUR_BOUNDS, HOUR_LEVELS)


def bin_centre(value: Column, width: int) -> Column:
    """Centre of the histogram bin of ``value``; bins sit on multiples of ``width``.

    A value on an edge belongs to the lower bin, as histogram bins are closed
    on the right.
    """
    return F.ceil(value.cast("double") / F.lit(float(width)) - 0.5) * width


def level_rank(label: Column, levels: Sequence[str]) -> Column:
    """Position of ``label`` in a custom display order; labels not listed come last."""
    out = F.when(label == levels[0], 0)
    for rank, level in enumerate(levels[1:], start=1):
        out = out.when(label == level, rank)
    return out.otherwise(len(levels))
