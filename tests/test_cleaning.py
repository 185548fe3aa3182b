"""Reading and cleaning: headers, missing markers, ids, streaks and CSV files."""

from datetime import datetime
from decimal import Decimal

import pytest
from fixture import rows
from hypothesis import given
from hypothesis import strategies as st

from streakline.sources import cleaning, readers, schemas
from streakline.spec import ID


def test_snake_case():
    names = ["Unique Customer ID", "mostUsedDevice", "Most-Used  Platform", "% share", "...12", "", "ÄB c"]
    assert [cleaning.snake_case(n) for n in names] == [
        "unique_customer_id",
        "most_used_device",
        "most_used_platform",
        "percent_share",
        "x12",
        "x",
        "äb_c",
    ]


def test_repeated_headers_get_numbers():
    assert cleaning.unique_names(["A b", "a_b", "A-B", "c"]) == ["a_b", "a_b_2", "a_b_3", "c"]


@given(st.lists(st.text(max_size=12), max_size=6))
def test_snake_case_settles(names):
    once = [cleaning.snake_case(n) for n in names]
    assert [cleaning.snake_case(n) for n in once] == once
    assert all(n and n[0].isalpha() for n in once)


def test_null_scrub_only_touches_the_marker(spark):
    df = spark.createDataFrame([("null", "nullx", 1), (None, "null", 2)], "a STRING, b STRING, n INT")
    assert rows(cleaning.null_scrub(df)) == [(None, "nullx", 1), (None, None, 2)]
    assert rows(cleaning.null_scrub(df, ["a"])) == [(None, "nullx", 1), (None, "null", 2)]


def test_sanitize_streak(spark):
    values = ["5", "-1", None, "null", "7.0", " 3 ", "x"]
    df = spark.createDataFrame([(v,) for v in values], "current_streak_value STRING")
    assert [r[0] for r in cleaning.sanitize_streak(df).collect()] == [5, 0, 0, 0, 7, 3, 0]


def test_prefix_is_only_taken_from_the_front(spark):
    df = spark.createDataFrame([("shop:7",), ("8",), ("x:shop:9",)], f"{ID} STRING")
    assert [r[0] for r in cleaning.strip_id_prefix(df, "shop:").collect()] == ["7", "8", "x:shop:9"]
    assert [r[0] for r in cleaning.strip_id_prefix(df, "shop:", "bigint").collect()] == [7, 8, None]


def test_csv_log(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text(
        "Unique Customer Id,Timestamp,Event,Action,currentStreakValue,Collectable Type,extra\n"
        "u1,2024-12-03 09:00:00,participate,null,3,win,?\n"
        "u2,not a time,participate,opened,null,null,?\n"
    )
    got = readers.read_log(spark, str(path)).orderBy(ID).collect()
    assert got[0]["timestamp"] == datetime(2024, 12, 3, 9) and got[0]["action"] is None
    assert (got[0]["current_streak_value"], got[1]["current_streak_value"]) == (3, 0)
    assert got[1]["timestamp"] is None and got[1]["collectable_type"] is None
    assert got[0]["event_id"] is None and got[0]["collectable_value"] is None
    assert got[0]["event"] == "participate"


def test_csv_coupons_and_transactions(spark, tmp_path):
    coupons, orders = tmp_path / "c.csv", tmp_path / "t.csv"
    coupons.write_text(
        "unique_customer_id,event_type,code,timestamp,value,value_type\n"
        "u1,issued,null,2024-12-03 09:00:00,5.50,Fixed\n"
    )
    orders.write_text(
        "unique_customer_id,order_id,order_local_timestamp,demand,coupon_discount,coupon_code\n"
        "u1,o1,2024-12-03 09:00:00,12.34,,\n"
    )
    c = readers.read_coupons(spark, str(coupons)).first()
    assert (c["code"], c["value"]) == (None, Decimal("5.50"))
    t = readers.read_transactions(spark, str(orders)).first()
    assert (t["demand"], t["coupon_discount"], t["coupon_code"]) == (Decimal("12.34"), None, None)


ORDERS = "unique_customer_id,order_id,order_local_timestamp,demand,coupon_discount,coupon_code\n"


def test_csv_quotes_newlines_and_zones(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(
        ORDERS
        + 'u1,"A ""x"", y",2024-12-03T23:30:00+02:00,1.00,,"c,d"\n'
        + 'u2,"two\nlines",2024-12-03 23:30:00,2.00,,\n'
        + "u3,o3,2024-12-03T23:30:00Z,3.00,,\n"
        + "u4,o4,03/12/2024 10:00,x,,\n"
    )
    got = readers.read_table(spark, str(path), schemas.TRANSACTIONS, multi_line=True)
    found = {r[ID]: r for r in got.collect()}
    assert [found[k]["order_id"] for k in ("u1", "u2")] == ['A "x", y', "two\nlines"]
    assert found["u1"]["coupon_code"] == "c,d"
    assert found["u1"]["order_local_timestamp"] == datetime(2024, 12, 3, 21, 30)
    assert found["u2"]["order_local_timestamp"] == datetime(2024, 12, 3, 23, 30)
    assert found["u3"]["order_local_timestamp"] == datetime(2024, 12, 3, 23, 30)
    raw = readers.read_source(spark, str(path), multi_line=True)
    rejects = readers.source_rejects(raw, schemas.TRANSACTIONS, "orders")
    assert rows(rejects.orderBy("column")) == [
        ("orders", "coupon_discount", 0, 0),
        ("orders", "demand", 4, 1),
        ("orders", "order_local_timestamp", 4, 1),
    ]


def test_missing_required_column_is_an_error(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(ORDERS.replace("unique_customer_id", "customer") + "u1,o1,2024-12-03,1,,\n")
    with pytest.raises(ValueError, match="unique_customer_id"):
        readers.read_transactions(spark, str(path))


def test_csv_customers(spark, tmp_path):
    path = tmp_path / "customers.csv"
    path.write_text(
        "Unique Customer ID,Gender,Age,Urbanisation,First Order Year,\n"
        "shop:u1,V,25-29,null,2019,zzz\n"
    )
    got = readers.read_customers(spark, str(path), id_prefix="shop:").first()
    assert (got[ID], got["urbanisation"], got["first_order_year"]) == ("u1", None, 2019)


def test_parquet_source(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql(
        "SELECT 'u1' AS unique_customer_id, 1 AS order_id, timestamp_ntz'2024-12-03 09:00:00'"
        " AS order_local_timestamp, 5D AS demand"
    ).write.parquet(path)
    got = readers.read_transactions(spark, path, "parquet").first()
    assert (got["order_id"], got["demand"], got["coupon_code"]) == ("1", Decimal("5.00"), None)
