"""One customer with a third of all events, checked against plain Python."""

from collections import Counter, defaultdict
from datetime import date, datetime, timedelta
from random import Random

import pytest
from pyspark.sql import functions as F

from streakline.operators import activity, audit, daily, events, profile, quality, retention
from streakline.operators import rewards, streaks
from streakline.sources.readers import tier_table
from streakline.spec import ID, CampaignSpec, numbered_tiers

SPEC = CampaignSpec(
    date(2024, 3, 20), date(2024, 4, 5), tiers=numbered_tiers("R"), code_marker="R"
)
KINDS = ["enter", "participate", "participate", "collectable_interaction"]
SCHEMA = f"""event_id BIGINT, {ID} STRING, timestamp TIMESTAMP_NTZ, event STRING, action STRING,
current_streak_value INT, collectable_type STRING, collectable_value STRING"""


@pytest.fixture(scope="module")
def data():
    rnd = Random(9)
    out = []
    for i in range(6000):
        who = "hot" if i % 3 == 0 else f"u{rnd.randrange(150)}"
        event = rnd.choice(KINDS)
        action = rnd.choice(["opened", "claimed", "selected", None]) if "inter" in event else None
        # whole seconds over few days, so equal timestamps occur
        ts = datetime(2024, 3, 18) + timedelta(seconds=rnd.randrange(20 * 24) * 3600)
        code = f"R{rnd.randrange(1, 7)}" if action == "selected" else None
        out.append((i, who, ts, event, action, rnd.randrange(0, 6), rnd.choice("abc"), code))
    return out


@pytest.fixture(scope="module")
def log(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(6).cache()


@pytest.fixture(scope="module")
def camp(data):
    return [r for r in data if SPEC.start <= r[2].date() <= SPEC.end]


def test_engagement(log, camp):
    want = defaultdict(list)
    for r in camp:
        want[r[1]].append(r)
    got = {r[ID]: r for r in profile.engagement_summary(events.campaign_window(log, SPEC), SPEC).collect()}
    assert set(got) == set(want)
    for who, rs in want.items():
        last = max(rs, key=lambda r: (r[2], r[0]))
        assert got[who]["n_interactions"] == len(rs)
        assert got[who]["n_opens"] == sum(r[3] == "participate" or r[4] == "opened" for r in rs)
        assert got[who]["final_streak"] == last[5] and got[who]["max_streak"] == max(r[5] for r in rs)


def test_open_rate(log, camp):
    opens = [r for r in camp if r[3] == "participate"]
    users = defaultdict(set)
    for r in opens:
        users[r[2].date()].add(r[1])
    total = Counter(r[2].date() for r in opens)
    got = daily.daily_open_rate(events.campaign_window(log, SPEC), SPEC).collect()
    assert len(got) == SPEC.days
    for r in got:
        assert r["unique_opens"] == len(users[r["open_date"]])
        assert r["total_opens"] == total[r["open_date"]]
        assert r["participants"] == len({x[1] for x in opens})


def test_first_selection(spark, log, data):
    want = {}
    for r in sorted((r for r in data if r[7]), key=lambda r: (r[2], r[0])):
        want.setdefault(r[1], r[7])
    got = rewards.reward_selection(log, tier_table(spark, SPEC.tiers), SPEC)
    assert {r[ID]: r["collectable_value"] for r in got.collect()} == want
    assert {r["selected_tier"] for r in got.filter("collectable_value = 'R6'").collect()} <= {None}


def test_audit_and_rebuild(log, camp):
    last = {}
    for r in sorted((r for r in camp if r[3] == "participate"), key=lambda r: (r[2], r[0])):
        last[r[1], r[2].date()] = r[5]
    days = defaultdict(list)
    for who, day in sorted(last):
        days[who].append(day)
    audited = audit.streak_audit(log, SPEC)
    assert {(r[ID], r["activity_date"]): r["current_streak_value"] for r in audited.collect()} == last

    inconsistent = set()
    for who, ds in days.items():
        for prev, day in zip([None, *ds], ds):
            if (prev is None or (day - prev).days > 1) and last[who, day] > 1:
                inconsistent.add((who, day))
    gaps = audit.streak_gap_analysis(audited)
    assert {
        (r[ID], r["activity_date"]) for r in gaps.filter("inconsistent_streak").collect()
    } == inconsistent

    flags = {r[ID]: r for r in streaks.rebuild_flags(activity.activity_bitmaps(log, SPEC), SPEC).collect()}
    for who, ds in days.items():
        breaks = [i for i in range(1, len(ds)) if (ds[i] - ds[i - 1]).days > 1]
        assert flags[who]["n_breaks"] == len(breaks)
        assert flags[who]["first_break_position"] == (breaks[0] + 1 if breaks else None)
        assert flags[who]["tried_to_rebuild"] == bool(breaks and breaks[0] + 1 < len(ds))


def test_retention(log, camp):
    first = {}
    for r in sorted((r for r in camp if r[3] == "participate"), key=lambda r: r[2]):
        first.setdefault(r[1], r[2].date())
    engaged = {(r[1], r[2].date()) for r in camp if r[3] != "enter"}
    want = Counter(
        (d - first[who]).days for who, d in engaged if who in first and d >= first[who]
    )
    curve = retention.retention_overall(retention.retention_lifecycle(log, SPEC), horizon=30)
    assert {r["days_since_cohort"]: r["active_users"] for r in curve.collect()} == dict(want)


def test_leakage_with_a_hot_customer(spark, log, data):
    orders = [
        (str(i), "hot" if i % 2 else f"u{i % 150}", datetime(2024, 3, 22), 10.0, (i % 7) / 4, f"R{i % 6 + 1}")
        for i in range(2000)
    ]
    txn = spark.createDataFrame(
        orders,
        f"order_id STRING, {ID} STRING, order_local_timestamp TIMESTAMP_NTZ, demand DOUBLE,"
        " coupon_discount DOUBLE, coupon_code STRING",
    )
    gaps = audit.streak_gap_analysis(audit.streak_audit(log, SPEC))
    affected = {r[ID] for r in gaps.filter("inconsistent_streak").select(ID).distinct().collect()}
    picked = Counter((r[1], r[7]) for r in data if r[7] and r[1] in affected)
    once = sum(o[4] for o in orders if (o[1], o[5]) in picked)
    raw = sum(o[4] * picked[o[1], o[5]] for o in orders)
    got = audit.reward_leakage(audit.affected_selections(log, gaps, SPEC), txn).first()
    cents = [round(o[4] * 100) for o in orders]
    assert all(c == o[4] * 100 for c, o in zip(cents, orders))
    assert got["leakage"] == pytest.approx(once) and got["leakage_raw"] == pytest.approx(raw)


def test_only_heavy_customers_are_salted(spark, log, data):
    salts = 12
    counts = Counter(r[1] for r in data)
    heavy = quality.heavy_customers(log, salts)
    expected = [who for who, n in counts.items() if n * salts > len(data)]
    assert heavy.first()["heavy"] == expected == ["hot"]
    ids = spark.createDataFrame([(who,) for who in [*counts, "absent"]], f"{ID} STRING")
    salted = Counter(r[ID] for r in quality.salted_ids(ids, heavy, salts).collect())
    assert salted == Counter(dict.fromkeys(ids.toPandas()[ID], 1) | {"hot": salts})
    nobody = quality.heavy_customers(log.limit(0), salts)
    assert nobody.first()["heavy"] == [] and quality.salted_ids(ids, nobody, salts).count() == ids.count()


def test_timeline_spreads_a_hot_customer(spark, log, data):
    ids = spark.createDataFrame([("hot",), ("u1",), ("absent",)], f"{ID} STRING")
    coupons = spark.createDataFrame(
        [("hot", "issued", "R1", datetime(2024, 3, 22)), ("u2", "issued", "R1", datetime(2024, 3, 22))],
        f"{ID} STRING, event_type STRING, code STRING, timestamp TIMESTAMP_NTZ",
    )
    txn = spark.createDataFrame(
        [("u1", "o1", datetime(2024, 3, 23), 1.5)],
        f"{ID} STRING, order_id STRING, order_local_timestamp TIMESTAMP_NTZ, demand DOUBLE",
    )
    got = quality.customer_timeline(ids, log, coupons, txn)
    want = Counter((r[1], "log", r[3], r[4], r[2]) for r in data if r[1] in ("hot", "u1"))
    want["hot", "coupons", "issued", "R1", datetime(2024, 3, 22)] += 1
    want["u1", "transactions", "o1", "1.500000", datetime(2024, 3, 23)] += 1
    assert Counter(map(tuple, got.collect())) == want

    # without broadcasts, the hot customer's records meet the ids in several partitions
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spread = quality.customer_timeline(ids, log, coupons, txn).filter(f"{ID} = 'hot'")
        assert spread.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
