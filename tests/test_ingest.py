"""Times with zones, amounts with many decimals, and what does not fit its column."""

import json
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from test_run import exports  # noqa: F401

from streakline.functions.nulls import mean_money, sum_money
from streakline.plans import run
from streakline.plans.workspace import Workspace
from streakline.sources import readers, schemas
from streakline.spec import ID, CampaignSpec, PeriodSpec, numbered_tiers

NOON = datetime(2024, 12, 3, 23, 30)


@pytest.mark.parametrize("session_zone", ["UTC", "America/New_York"])
def test_zones(spark, session_zone):
    times = {
        "2024-12-03T23:30:00+02:00": datetime(2024, 12, 3, 21, 30),
        "2024-12-03T23:30:00+02": datetime(2024, 12, 3, 21, 30),
        "2024-12-03 23:30+2": datetime(2024, 12, 3, 21, 30),
        "2024-12-03T23:30:00 Europe/Amsterdam": datetime(2024, 12, 3, 22, 30),
        "2024-12-03T23:30:00+01:00[Europe/Amsterdam]": datetime(2024, 12, 3, 22, 30),
        "2024-12-03T23:30:00[Europe/Amsterdam]": datetime(2024, 12, 3, 22, 30),
        "2024-12-03T23:30:00 CET": datetime(2024, 12, 3, 22, 30),
        "2024-12-03T23:30:00z": NOON,
        "2024-12-03T23:30:00Z": NOON,
        "2024-12-03T23:30:00 UTC": NOON,
        "2024-12-03T23:30:00-0500": datetime(2024, 12, 4, 4, 30),
        "2024-12-03T23:30:00.25 GMT-05:30": datetime(2024, 12, 4, 5, 0, 0, 250_000),
        "2024-12-03T23:30:00": NOON,
        "2024-12-03 23:30:00.123456": datetime(2024, 12, 3, 23, 30, 0, 123_456),
        "  2024-12-03 23:30  ": NOON,
        "2024-12-03": datetime(2024, 12, 3),
        # clocks go from 2 to 3, and from 3 back to 2
        "2024-03-31T01:59:59 Europe/Amsterdam": datetime(2024, 3, 31, 0, 59, 59),
        "2024-03-31T02:30:00 Europe/Amsterdam": datetime(2024, 3, 31, 1, 30),
        "2024-03-31T03:00:00 Europe/Amsterdam": datetime(2024, 3, 31, 1, 0),
        "2024-10-27T01:59:59 Europe/Amsterdam": datetime(2024, 10, 26, 23, 59, 59),
        "2024-10-27T02:30:00 Europe/Amsterdam": datetime(2024, 10, 27, 0, 30),
        "2024-10-27T03:00:00 Europe/Amsterdam": datetime(2024, 10, 27, 2, 0),
    }
    bad = ["2024-12-03T23:30:00 Nowhere/City", "2024-12-03T23:30:00+25", "23:30", "2024", "soon", "", None,
           "2024-13-03 10:00", "2024-12-03T25:00:00", "03/12/2024 10:00", "2024-12-03T23:30:00 x"]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        frame = spark.createDataFrame([(t,) for t in [*times, *bad]], "t STRING")
        found = {r.t: r.u for r in frame.select("t", readers.utc_timestamp(F.trim("t")).alias("u")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert {t: found[t] for t in times} == times
    assert {t: found[t] for t in bad} == dict.fromkeys(bad)


def test_amounts_keep_six_decimals_and_add_up(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(
        "unique_customer_id,order_id,order_local_timestamp,demand,coupon_discount,coupon_code\n"
        "u1,o1,2024-12-03,12.345,0.000001,\nu1,o2,2024-12-03,6000000000000,,\nu1,o3,2024-12-03,6000000000000,,\n"
        "u2,o4,2024-12-03,-6000000000000.5,,\n"
    )
    orders = readers.read_transactions(spark, str(path))
    assert orders.filter("order_id = 'o1'").first()["demand"] == Decimal("12.345")
    sums = {r[ID]: r for r in orders.groupBy(ID).agg(sum_money(F.col("demand")).alias("s"), sum_money(F.col("coupon_discount")).alias("c")).collect()}
    assert (sums["u1"].s, sums["u1"].c) == (12_000_000_000_012.345, 0.000001)
    assert (sums["u2"].s, sums["u2"].c) == (-6_000_000_000_000.5, 0.0)
    row = orders.agg(sum_money(F.col("demand")), mean_money(F.col("demand"))).first()
    # doubles of this size are a thousandth apart
    assert row[0] == pytest.approx(6_000_000_000_011.845, abs=0.001) and row[1] == pytest.approx(row[0] / 4, rel=1e-15)


LOG = (
    "Unique Customer Id,Timestamp,Event Id,Event,Action,Current Streak Value\n"
    "u1,2024-12-03 09:00:00 CET,1,participate,null,3\n"
    "null,2024-12-03 09:00:00,2,participate,null,4\n"
    "u2,soon,x,participate,null,three\n"
    "u3,2024-12-03 09:00:00,3,participate\n"
    "u4,2024-12-03 09:00:00,4,participate,null,1,surplus\n"
    ",,5,enter,,\n"
)


def test_what_does_not_fit_is_kept_with_its_record(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text(LOG)
    found = readers.read_checked(spark, str(path), "log")
    assert found.count() == 6
    counts = {
        r["column"]: (r["n_values"], r["n_rejected"])
        for r in readers.reject_counts(found, schemas.LOG, "log", schemas.TYPED_LATER["log"]).collect()
    }
    assert counts == {
        ID: (6, 2), "timestamp": (5, 1), "event_id": (6, 1), "current_streak_value": (4, 1), "_corrupt_record": (6, 2),
    }
    rows = [r.asDict() for r in readers.quarantine(found, "log").collect()]
    assert all(r["table"] == "log" and r["file"].endswith("/log.csv") for r in rows)
    values = {(r["column"], r["value"]) for r in rows}
    assert values == {
        (ID, "null"), (ID, None), ("timestamp", "soon"), ("event_id", "x"), ("current_streak_value", "three"),
        ("_corrupt_record", "u3,2024-12-03 09:00:00,3,participate"),
        ("_corrupt_record", "u4,2024-12-03 09:00:00,4,participate,null,1,surplus"),
    }
    record = next(json.loads(r["record"]) for r in rows if r["value"] == "soon")
    assert (record[ID], record["event_id"], record["event"]) == ("u2", "x", "participate")
    # what fits in a malformed line is still used
    log = {r["event_id"]: r for r in readers.read_log(spark, str(path)).collect()}
    assert log[1]["timestamp"] == datetime(2024, 12, 3, 8) and log[3][ID] == "u3" and log[4]["current_streak_value"] == 1


def test_typed_sources_are_checked_too(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql(
        f"""SELECT * FROM VALUES ('u1', 'o1', timestamp_ntz'2024-12-03 09:00:00', 5D),
            (NULL, 'o2', NULL, double('NaN')) AS t({ID}, order_id, order_local_timestamp, demand)"""
    ).write.parquet(path)
    found = readers.read_checked(spark, path, "transactions", "parquet")
    counts = {r["column"]: (r["n_values"], r["n_rejected"]) for r in readers.reject_counts(found, schemas.TRANSACTIONS, "t").collect()}
    assert counts == {
        ID: (2, 1), "order_local_timestamp": (1, 0), "demand": (2, 1), "coupon_discount": (0, 0), "_corrupt_record": (2, 0),
    }


def test_rejects_of_all_exports_through_the_runner(spark, exports, tmp_path):  # noqa: F811
    folder = tmp_path / "in"
    folder.mkdir()
    for name in schemas.EXPORTS:
        (folder / f"{name}.csv").write_text((exports / f"{name}.csv").read_text())
    with (folder / "log.csv").open("a") as f:
        f.write("x9,u1,2024-12-33 09:00:00,participate,null,3,win,null\n")
    with (folder / "coupons.csv").open("a") as f:
        f.write("u2,issued,T2,2024-12-22 10:00:01,ten,Fixed\n")
    with (folder / "transactions.csv").open("a") as f:
        f.write('u2,o9,2024-12-22,"1,5",?,\n')
    with (folder / "customers.csv").open("a") as f:
        f.write(",V,25-29,P1,many,app,ios,toys,1,2019,x\n")
    campaign = CampaignSpec(date(2024, 12, 3), date(2024, 12, 24), tiers=numbered_tiers("T"), code_marker="T")
    periods = PeriodSpec(date(2023, 12, 1), campaign.start, campaign.end, date(2025, 12, 31))
    paths = {n: str(folder / f"{n}.csv") for n in schemas.EXPORTS}
    space = Workspace(spark, str(tmp_path))
    out = str(tmp_path / "out")
    tables = run.read_exports(spark, paths, campaign, periods, "shop:", space=space)
    run.write_reports(tables, out, ["source_rejects", "rejected_values"], space)
    counts = {(r["table"], r["column"]): r["n_rejected"] for r in spark.read.parquet(f"{out}/source_rejects").collect()}
    assert len(counts) == 19
    assert {k for k, n in counts.items() if n} == {
        ("log", "event_id"), ("log", "timestamp"), ("coupons", "value"), ("transactions", "demand"),
        ("transactions", "coupon_discount"), ("customers", ID), ("customers", "orders"),
    }
    values = {(r["table"], r["column"]): r["value"] for r in spark.read.parquet(f"{out}/rejected_values").collect()}
    assert values["transactions", "demand"] == "1,5" and values["log", "timestamp"] == "2024-12-33 09:00:00"
    space.close()


def test_line_breaks_in_quotes_through_the_readers(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('unique_customer_id,event_type,code,timestamp,value,value_type\nu1,"is\nsued",T1,2024-12-03,1,Fixed\n')
    found = readers.read_coupons(spark, str(path), multi_line=True).collect()
    assert [r["event_type"] for r in found] == ["is\nsued"]
