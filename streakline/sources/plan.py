"""The campaign's own plan as files: its calendar of rewards and its reward tiers.

Both are small by their meaning, a row a campaign day and a row a reward code; a file of
more rows than ``MAX_ROWS`` is an error, so that nothing larger reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Row, SparkSession

from streakline.sources import schemas
from streakline.sources.readers import REJECTS, checked, read_source
from streakline.spec import RewardDay, RewardTier

MAX_ROWS = 10_000


def _rows(spark: SparkSession, path: str, ddl: str, required: tuple[str, ...], fmt: str) -> list[Row]:
    named = read_source(spark, path, fmt, keep_malformed=True)
    missing = [c for c in required if c not in named.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    rows = checked(named, ddl).limit(MAX_ROWS + 1).collect()
    if not rows or len(rows) > MAX_ROWS:
        raise ValueError(f"{path} needs between 1 and {MAX_ROWS} rows")
    for row in rows:
        wrong = [f"{r['column']} {r['value']!r}" for r in row[REJECTS] or ()]
        wrong += [f"no {c}" for c in required if row[c] is None]
        if wrong:
            raise ValueError(f"{path}: {', '.join(wrong)}")
    key = required[0]
    if len({row[key] for row in rows}) < len(rows):
        raise ValueError(f"{path} gives a {key} twice")
    return rows


def read_reward_days(spark: SparkSession, path: str, fmt: str = "csv") -> tuple[RewardDay, ...]:
    """The calendar of rewards in the order of its days: date, type and, where there are any,
    description, code, flat_discount_amount and percentage_rate. Missing amounts are 0."""
    rows = _rows(spark, path, schemas.REWARD_CALENDAR, ("date", "type"), fmt)
    days = [
        RewardDay(
            r["date"], r["type"], r["code"], r["flat_discount_amount"] or 0, r["percentage_rate"] or 0,
            r["description"],
        )
        for r in rows
    ]
    return tuple(sorted(days, key=lambda d: d.day))


def read_tiers(spark: SparkSession, path: str, fmt: str = "csv") -> tuple[RewardTier, ...]:
    """Reward codes (code, tier, value) from the lowest tier up."""
    rows = _rows(spark, path, schemas.TIERS, ("code", "tier", "value"), fmt)
    return tuple(sorted((RewardTier(*r[:3]) for r in rows), key=lambda t: (t.tier, t.code)))
