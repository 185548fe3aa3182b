"""Campaign parameters.

Everything an analysis would otherwise hard-code (dates, event names, reward
tiers, day counts) lives here, so one operator serves any campaign.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

ID = "unique_customer_id"


@dataclass(frozen=True)
class RewardTier:
    """One streak reward: the code in the log, the streak it stands for, its value."""

    code: str
    tier: int
    value: int


@dataclass(frozen=True)
class RewardDay:
    """What the daily card gives on one day of the campaign."""

    day: date
    kind: str
    code: str | None = None
    flat_amount: int = 0
    percentage_rate: int = 0
    description: str | None = None


# The streak each reward code stands for, and what the code is
# worth. The two differ on purpose for the last code.
TIER_STREAKS = (5, 10, 15, 20, 22)
TIER_VALUES = (5, 10, 15, 20, 25)

# Kind, flat amount off and percentage off for campaign days 1-22.
REWARD_SCHEDULE = (
    ("coupon", 0, 10),
    ("coupon", 0, 10),
    ("win", 0, 0),
    ("coupon", 0, 15),
    ("tip", 0, 0),
    ("coupon", 5, 0),
    ("coupon", 0, 10),
    ("win", 0, 0),
    ("coupon", 0, 10),
    ("tip", 0, 0),
    ("win", 0, 0),
    ("coupon", 0, 10),
    ("win", 0, 0),
    ("coupon", 0, 15),
    ("tip", 0, 0),
    ("coupon", 5, 0),
    ("coupon", 0, 20),
    ("win", 0, 0),
    ("coupon", 0, 10),
    ("tip", 0, 0),
    ("coupon", 0, 10),
    ("coupon", 0, 15),
)


def numbered_tiers(prefix: str) -> tuple[RewardTier, ...]:
    """Tiers whose codes are ``prefix`` followed by 1, 2, 3 ..."""
    return tuple(
        RewardTier(f"{prefix}{i}", tier, value)
        for i, (tier, value) in enumerate(zip(TIER_STREAKS, TIER_VALUES), start=1)
    )


def scheduled_rewards(start: date) -> tuple[RewardDay, ...]:
    """The standard 22-day schedule laid out from ``start``; codes are kind + day of month."""
    days = []
    for offset, (kind, flat, rate) in enumerate(REWARD_SCHEDULE):
        day = start + timedelta(days=offset)
        days.append(RewardDay(day, kind, f"{kind.upper()}{day.day}", flat, rate))
    return tuple(days)


@dataclass(frozen=True)
class CampaignSpec:
    """Window, event vocabulary and reward tiers of one campaign.

    ``start`` and ``end`` are both inclusive. Timestamps are read as UTC wall
    clock; ``timezone`` is where the customers live.
    """

    start: date
    end: date
    timezone: str = "Europe/Amsterdam"
    enter: str = "enter"
    onboard: str = "onboarding_completed"
    participate: str = "participate"
    interaction: tuple[str, ...] = ("collectable_interaction",)
    opened: str = "opened"
    claimed: str = "claimed"
    selected: str = "selected"
    tiers: tuple[RewardTier, ...] = ()
    code_marker: str = ""
    full_streak: int | None = None

    @property
    def days(self) -> int:
        return (self.end - self.start).days + 1

    @property
    def ultimate_streak(self) -> int:
        """The streak of a customer who took part every day, unless ``full_streak`` is given."""
        return self.days if self.full_streak is None else self.full_streak


@dataclass(frozen=True)
class PeriodSpec:
    """The order history around a campaign: before, during and after it."""

    pre_start: date
    start: date
    end: date
    post_end: date

    @property
    def pre_days(self) -> int:
        return (self.start - self.pre_start).days

    @property
    def during_days(self) -> int:
        return (self.end - self.start).days + 1

    @property
    def post_days(self) -> int:
        return (self.post_end - self.end).days
