"""Days as bits, against plain Python sets, for campaigns of any length."""

from datetime import date, datetime, timedelta
from random import Random

import pytest
from pyspark.sql import functions as F

from streakline.functions import bits
from streakline.operators import activity, events, retention, streaks
from streakline.spec import ID, CampaignSpec

START = date(2023, 11, 3)
LENGTHS = (1, 22, 62, 63, 64, 65, 126, 127, 400)
SCHEMA = f"{ID} STRING, timestamp TIMESTAMP_NTZ, event STRING, action STRING"


def campaign(days):
    return CampaignSpec(START, START + timedelta(days=days - 1))


def day_sets(days):
    """Participation and card days of customers: random ones, edges of words, all, none."""
    rng = Random(days)
    edges = {d for d in (0, 61, 62, 63, 64, 125, 126, 127, days - 1) if d < days}
    sets = {
        "edges": (edges, set()), "all": (set(range(days)), {0}), "last": ({days - 1}, set(range(days))),
        "cards": (set(), {0, days - 1}), "outside": (set(), set()), None: ({0}, {days - 1}),
    }
    for i in range(25):
        share = rng.choice((0.05, 0.3, 0.9))
        sets[f"u{i}"] = tuple({d for d in range(days) if rng.random() < share} for _ in range(2))
    return sets


def log_of(spark, sets, days):
    rows = []
    for who, (own, cards) in sets.items():
        rows += [(who, d, "participate", None) for d in own] * 2
        rows += [(who, d, "collectable_interaction", "opened") for d in cards]
        rows += [(who, d, k, None) for d in (-1, days) for k in ("participate", "enter")]
        rows += [(who, 0, "enter", None)]
    at = datetime(START.year, START.month, START.day, 23, 59, 59)
    rows = [(who, at + timedelta(days=d), e, a) for who, d, e, a in rows] + [("u0", None, "participate", None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def runs_of(days):
    out = []
    for d in sorted(days):
        if out and d == out[-1][-1] + 1:
            out[-1].append(d)
        else:
            out.append([d])
    return out


@pytest.mark.parametrize("days", LENGTHS)
def test_sets_runs_breaks_and_cohorts(spark, days):
    spec, sets = campaign(days), day_sets(days)
    log = log_of(spark, sets, days)
    found = activity.activity_bitmaps(log, spec).cache()
    members = {r[ID]: (set(r.p), set(r.e)) for r in found.select(
        ID, bits.members(F.col("participated"), days).alias("p"), bits.members(F.col("engaged"), days).alias("e")
    ).collect()}
    assert members == {who: (p, p | c) for who, (p, c) in sets.items() if p | c}

    day = lambda d: None if d is None else START + timedelta(days=d)
    took_part = {who: p for who, (p, _) in sets.items() if p}
    runs = {r[ID]: tuple(r)[1:] for r in activity.activity_runs(found, spec).collect()}
    flags = {r[ID]: r for r in streaks.rebuild_flags(found, spec).collect()}
    assert runs.keys() == flags.keys() == took_part.keys()
    for who, own in took_part.items():
        expected = runs_of(own)
        last = expected[-1]
        assert runs[who] == (
            len(own), len(expected), max(map(len, expected)), len(last) if last[-1] == days - 1 else 0,
            day(expected[0][0]), day(last[-1]),
        )
        r = flags[who]
        assert (r.total_active_days, r.n_breaks) == (len(own), len(expected) - 1)
        assert r.first_break_position == (len(expected[0]) + 1 if len(expected) > 1 else None)

    gaps = [(r[ID], r.activity_date, r.prev_date, r.gap_days) for r in streaks.streak_gaps(found, spec).collect()]
    expected = [
        (who, day(d), day(p), None if p is None else d - p)
        for who, own in took_part.items()
        for p, d in zip([None, *sorted(own)], sorted(own))
    ]
    assert sorted(gaps, key=str) == sorted(expected, key=str)

    lifecycle = [tuple(r) for r in retention.lifecycle_of(found, spec).collect()]
    expected = [
        (who, day(d), day(min(p)), d - min(p))
        for who, (p, c) in sets.items() if p for d in p | c if d >= min(p)
    ]
    assert sorted(lifecycle, key=str) == sorted(expected, key=str)
    cohorts = {r[ID]: r.cohort_date for r in retention.cohorts_of(found, spec).collect()}
    assert cohorts == {who: day(min(p)) for who, p in took_part.items()}
    for which, wanted in (("participated", 0), ("engaged", 1)):
        rows = sorted((r[0], r[1]) for r in activity.days_of(found.filter(f"{ID} = 'u1'"), spec, which).collect())
        p, c = sets["u1"]
        assert rows == [("u1", day(d)) for d in sorted((p, p | c)[wanted])]
    found.unpersist()


def test_days_added_later_merge(spark):
    days = 65
    spec, sets = campaign(days), day_sets(days)
    log = log_of(spark, sets, days)
    cut = datetime(START.year, START.month, START.day) + timedelta(days=40)
    parts = [activity.activity_bitmaps(log.filter(c), spec) for c in (F.col("timestamp") < cut, F.col("timestamp") >= cut)]
    merged = activity.merge_bitmaps(parts, spec)
    whole = activity.activity_bitmaps(log, spec)
    as_rows = lambda df: sorted(map(str, df.select(ID, "participated", "engaged").collect()))
    assert as_rows(merged) == as_rows(whole)


def test_bits_are_summed_in_a_hash_table(spark):
    days = 400
    log = log_of(spark, {"a": ({0, 399}, set())}, days)
    text = activity.activity_bitmaps(log, campaign(days))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in text and "SortAggregate" not in text and "ObjectHashAggregate" not in text


def test_the_days_as_rows_agree_with_the_events(spark):
    days = 64
    spec = campaign(days)
    log = log_of(spark, day_sets(days), days)
    found = activity.activity_bitmaps(log, spec)
    for which, rows in (
        ("participated", events.participation_days(log, spec)), ("engaged", events.user_daily_activity(log, spec)),
    ):
        days_found = activity.days_of(found, spec, which)
        assert sorted(map(str, days_found.collect())) == sorted(map(str, rows.collect()))
