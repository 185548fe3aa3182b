"""Predicates and windows over the event log that several analyses share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streakline.functions.dates import in_window
from streakline.spec import ID, CampaignSpec


def is_participation(spec: CampaignSpec) -> Column:
    return F.col("event") == spec.participate


def is_interaction(spec: CampaignSpec) -> Column:
    return F.col("event").isin(*spec.interaction)


def is_action(spec: CampaignSpec, action: str) -> Column:
    """A card interaction of one kind; an interaction without an action is none."""
    return is_interaction(spec) & (F.col("action") == action)


def campaign_window(log: DataFrame, spec: CampaignSpec) -> DataFrame:
    """Events on campaign days."""
    return in_window(log, "timestamp", spec.start, spec.end)


def engagement_events(log: DataFrame, spec: CampaignSpec) -> DataFrame:
    """Participations and card interactions on campaign days, with their day."""
    return (
        campaign_window(log, spec)
        .filter(F.col("event").isin(spec.participate, *spec.interaction))
        .select(ID, "event", "action", F.to_date("timestamp").alias("activity_date"), "timestamp")
    )


def user_daily_activity(log: DataFrame, spec: CampaignSpec) -> DataFrame:
    """Customers and the days they were engaged, once each."""
    return engagement_events(log, spec).select(ID, "activity_date").distinct()


def participation_days(log: DataFrame, spec: CampaignSpec) -> DataFrame:
    """Customers and the campaign days they participated on, once each."""
    return (
        campaign_window(log, spec)
        .filter(is_participation(spec))
        .select(ID, F.to_date("timestamp").alias("activity_date"))
        .distinct()
    )
