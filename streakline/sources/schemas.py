"""Declared schemas of the campaign exports; nothing is inferred from data."""

from __future__ import annotations

LOG = """
    unique_customer_id STRING, timestamp TIMESTAMP_NTZ, event_id BIGINT, event STRING,
    action STRING, current_streak_value STRING, collectable_type STRING,
    collectable_value STRING
"""
COUPONS = """
    unique_customer_id STRING, event_type STRING, code STRING, timestamp TIMESTAMP_NTZ,
    value DECIMAL(28,6), value_type STRING
"""
TRANSACTIONS = """
    unique_customer_id STRING, order_id STRING, order_local_timestamp TIMESTAMP_NTZ,
    demand DECIMAL(28,6), coupon_discount DECIMAL(28,6), coupon_code STRING
"""
CUSTOMERS = """
    unique_customer_id STRING, gender STRING, age STRING, province STRING, orders STRING,
    most_used_device STRING, most_used_platform STRING, most_popular_category STRING,
    urbanisation STRING, first_order_year STRING
"""
#: Types of values that are text in a table of its own columns, where rejects are counted.
TYPED_LATER = {
    "log": "current_streak_value INT",
    "customers": "orders INT, urbanisation INT, first_order_year INT",
}
EXPORTS = {"log": LOG, "coupons": COUPONS, "transactions": TRANSACTIONS, "customers": CUSTOMERS}
REWARD_CALENDAR = """
    date DATE, type STRING, description STRING, code STRING, flat_discount INT,
    flat_discount_amount INT, percentage_discount INT, percentage_rate INT
"""
TIERS = "code STRING, tier INT, value INT"
