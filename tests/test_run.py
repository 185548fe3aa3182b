"""The whole set of reports from CSV exports to parquet tables."""

import os

import pytest
from fixture import _LOG, _TRANSACTIONS

from streakline.plans.catalog import analyses
from streakline.plans.run import main

# one or two of each group; RUN_ALL_REPORTS=1 runs the rest as well
CHOSEN = [
    "id_summary",
    "numeric_summary",
    "customer_timeline",
    "funnel_independent",
    "customer360",
    "daily_open_rate",
    "top_days",
    "streak_stats_all_customers",
    "segment_gender",
    "segment_orders",
    "basket_by_tier",
    "incremental_impact",
    "ols_streak_orders_p_values",
    "retention_by_segment",
    "peak_hours",
    "rebuild_segments",
    "reward_leakage",
    "bug_discount_share",
]
ALL = os.environ.get("RUN_ALL_REPORTS") == "1"


@pytest.fixture(scope="module")
def exports(tmp_path_factory):
    folder = tmp_path_factory.mktemp("exports")
    log = ["Event Id,Unique Customer Id,Timestamp,Event,Action,Current Streak Value,"
           "Collectable Type,Collectable Value"]
    for line in _LOG.strip().splitlines():
        n, who, when, event, action, streak, value = line.split()
        log.append(f"{n},{who},2024-12-{when.replace('T', ' ')}:00,{event},{action},{streak},win,{value}")
    orders = ["unique_customer_id,order_id,order_local_timestamp,demand,coupon_discount,coupon_code"]
    for line in _TRANSACTIONS.strip().splitlines():
        order, who, when, demand, discount, code = line.split()
        orders.append(
            f"{who},{order},{when.replace('T', ' ')}:00,{demand},{discount},{'' if code == '-' else code}"
        )
    coupons = ["unique_customer_id,event_type,code,timestamp,value,value_type",
               "u2,issued,T2,2024-12-22 10:00:01,10.00,Fixed",
               "u9,issued,T1,2024-12-22 10:00:01,5,Percentage"]
    customers = ["Unique Customer Id,Gender,Age,Province,Orders,Most Used Device,Most Used Platform,"
                 "Most Popular Category,Urbanisation,First Order Year,"]
    for i in range(1, 9):
        customers.append(f"shop:u{i},{'VM'[i % 2]},2{i % 2 * 5}-29,P{i % 2},{i},app,ios,toys,{i % 5},2019,x")
    for name, lines in (("log", log), ("coupons", coupons), ("transactions", orders),
                        ("customers", customers)):
        (folder / f"{name}.csv").write_text("\n".join(lines) + "\n")
    return folder


def test_reports(spark, exports, tmp_path):
    out = str(tmp_path / "reports")
    argv = [f"--{n}={exports}/{n}.csv" for n in ("log", "coupons", "transactions", "customers")]
    main([*argv, f"--out={out}", "--start=2024-12-03", "--end=2024-12-24", "--pre-start=2023-12-01",
          "--post-end=2025-12-31", "--id-prefix=shop:", "--reward-code=T",
          *([] if ALL else ["--only", *CHOSEN])])
    # the shared customer table goes to the cluster's checkpoint folder if one is named
    assert set(os.listdir(out)) - {"_shared"} == set(analyses() if ALL else CHOSEN)

    def read(name):
        return spark.read.parquet(f"{out}/{name}")

    assert read("customer360").count() == 9
    assert tuple(read("funnel_independent").first()) == (6, 3, 3, 5)
    assert read("daily_open_rate").count() == 22
    assert read("reward_leakage").first()["leakage"] == 10.0
    assert read("segment_gender").agg({"n_participants": "sum"}).first()[0] == 5
    assert {r["table"]: r["unique_customers"] for r in read("id_summary").collect()}["customers"] == 8
    assert read("top_days").count() == 3
