"""Distinct customers from bitmaps, against plain Python sets."""

from collections import defaultdict
from datetime import date, datetime, timedelta
from random import Random

import pytest
from pyspark.sql import functions as F

from streakline.operators import distinct
from streakline.plans.bindings import Tables
from streakline.spec import ID, CampaignSpec

SPEC = CampaignSpec(date(2024, 3, 29), date(2024, 4, 2))


def rows():
    rng = Random(2)
    out = []
    for i in range(4000):
        who = "hot" if i % 3 == 0 else None if i % 50 == 1 else f"u{rng.randrange(700)}"
        at = datetime(2024, 3, 29) + timedelta(seconds=rng.randrange(5 * 86_400))
        out.append((who, at, "participate" if i % 7 else "enter"))
    return out


@pytest.mark.parametrize("customers", [distinct.RANGE, 100, 7])
def test_levels(spark, customers):
    """Few customers a range make many ranges, as many customers do."""
    events = spark.createDataFrame(rows(), f"{ID} STRING, timestamp TIMESTAMP_NTZ, event STRING").repartition(5)
    hours = distinct.participation_hours(events, SPEC)
    bitmaps = distinct.customer_bitmaps(hours, customers)
    opens, who = defaultdict(int), defaultdict(set)
    for name, at, event in rows():
        if event == "participate":
            change = datetime(2024, 3, 31, 1)
            local = at + timedelta(hours=2 if at >= change else 1)
            for key in (("day", at.date(), None), ("local day and hour", local.date(), local.hour),
                        ("local hour", None, local.hour), ("all", None, None)):
                opens[key] += 1
                if name is not None:
                    who[key].add(name)
    found = {(r.level, r.day, r.hour): (r.opens, r.customers) for r in distinct.participation_levels(bitmaps).collect()}
    assert found == {k: (n, len(who[k])) for k, n in opens.items()}


def test_numbers_have_no_gaps(spark):
    hours = spark.range(5000).select(
        F.concat(F.lit("c"), F.col("id") % 1000).alias(ID), F.lit(date(2024, 1, 1)).alias("day"),
    )
    found = distinct.numbered(hours, 100).select(ID, "range", "number").distinct().collect()
    by_range = defaultdict(set)
    for r in found:
        by_range[r.range].add(r.number)
    assert len(found) == 1000 and len(by_range) > 5
    assert all(own == set(range(1, len(own) + 1)) for own in by_range.values())


def test_no_events(spark):
    events = spark.createDataFrame([], f"{ID} STRING, timestamp TIMESTAMP_NTZ, event STRING")
    bitmaps = distinct.customer_bitmaps(distinct.participation_hours(events, SPEC))
    assert [tuple(r) for r in distinct.participation_levels(bitmaps).collect()] == [("all", None, None, 0, 0)]


def test_levels_share_one_aggregation_of_the_events(spark):
    found = distinct.participation_levels(Tables(spark, "/root/testdata/sf0.001").participation_bitmaps)
    found.collect()
    # of four levels, three reuse the first one's customers
    assert found._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") >= 3
