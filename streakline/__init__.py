"""Campaign and customer-engagement analytics as lazy Spark DataFrame operators."""

from streakline.spec import CampaignSpec, PeriodSpec, RewardDay, RewardTier

__all__ = ["CampaignSpec", "PeriodSpec", "RewardDay", "RewardTier"]
