"""A small December campaign, worked out by hand in FIXTURES.md."""

from __future__ import annotations

from datetime import date, datetime

from streakline.sources.cleaning import null_scrub, sanitize_streak
from streakline.spec import ID, CampaignSpec, PeriodSpec, RewardTier

SPEC = CampaignSpec(
    start=date(2024, 12, 3),
    end=date(2024, 12, 24),
    tiers=tuple(
        RewardTier(f"T{i}", tier, value)
        for i, (tier, value) in enumerate(((5, 5), (10, 10), (15, 15), (20, 20), (22, 25)), 1)
    ),
    code_marker="T",
)
PERIODS = PeriodSpec(date(2023, 12, 1), SPEC.start, SPEC.end, date(2025, 12, 31))

_LOG = """
1 u1 03T09:00 enter null 0 null
2 u1 03T09:01 onboarding_completed null 0 null
3 u1 03T09:02 participate null 1 null
4 u1 04T09:00 participate null 2 null
5 u1 05T09:00 participate null 3 null
6 u2 03T10:00 enter null 0 null
7 u2 03T10:01 onboarding_completed null 0 null
8 u2 03T10:02 participate null 1 null
9 u2 06T10:00 participate null 4 null
10 u2 07T10:00 participate null 5 null
11 u2 22T10:00 collectable_interaction selected 5 T2
12 u2 23T10:00 collectable_interaction selected 5 T2
13 u3 04T11:00 participate null 3 null
14 u3 10T11:00 participate null 1 null
15 u4 05T12:00 enter null 0 null
16 u5 09T23:30 participate null 1 null
17 u5 09T23:31 collectable_interaction opened 1 null
18 u5 09T23:32 collectable_interaction null 1 null
19 u6 02T08:00 participate null 1 null
20 u6 25T08:00 participate null 1 null
21 u7 03T13:00 onboarding_completed null -1 null
22 u7 03T13:01 participate null null null
"""
_TRANSACTIONS = """
o1 u2 2024-11-01T10:00 100 0 -
o2 u2 2024-12-24T10:00 80 10 T2
o3 u2 2024-12-23T10:00 50 0 T2
o4 u3 2024-12-12T10:00 40 5 T2
"""
LOG_SCHEMA = f"""event_id BIGINT, {ID} STRING, timestamp TIMESTAMP_NTZ, event STRING, action STRING,
current_streak_value STRING, collectable_type STRING, collectable_value STRING"""
TXN_SCHEMA = f"""order_id STRING, {ID} STRING, order_local_timestamp TIMESTAMP_NTZ,
demand DECIMAL(18,2), coupon_discount DECIMAL(18,2), coupon_code STRING"""


def raw_log(spark):
    rows = []
    for line in _LOG.strip().splitlines():
        n, who, when, event, action, streak, value = line.split()
        rows.append(
            (int(n), who, datetime.fromisoformat(f"2024-12-{when}"), event, action, streak, "null", value)
        )
    return spark.createDataFrame(rows, LOG_SCHEMA)


def log(spark):
    return sanitize_streak(null_scrub(raw_log(spark)))


def transactions(spark):
    from decimal import Decimal

    rows = []
    for line in _TRANSACTIONS.strip().splitlines():
        order, who, when, demand, discount, code = line.split()
        rows.append(
            (
                order,
                who,
                datetime.fromisoformat(when),
                Decimal(demand),
                Decimal(discount),
                None if code == "-" else code,
            )
        )
    return spark.createDataFrame(rows, TXN_SCHEMA)


def rows(df, *columns):
    """Rows as plain tuples, in the order the frame gives them."""
    return [tuple(r[c] for c in columns) if columns else tuple(r) for r in df.collect()]
