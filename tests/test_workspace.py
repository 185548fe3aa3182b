"""Per-customer buckets, exports that are parsed once, and runs that go on after a failure."""

import os
import re
from datetime import date, datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from test_run import exports  # noqa: F401

from streakline.operators import profile, retention
from streakline.plans import catalog, run
from streakline.plans.bindings import CAMPAIGN, PERIODS, Tables
from streakline.plans.customer_store import SOURCES, CustomerStore
from streakline.plans.workspace import Workspace, shared_root
from streakline.spec import ID, CampaignSpec, PeriodSpec, numbered_tiers

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def shuffled_joins(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture
def space(spark, tmp_path):
    made = Workspace(spark, str(tmp_path))
    yield made
    made.close()


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_the_customer_table_joins_buckets_without_a_shuffle(spark, space, shuffled_joins):
    t = Tables(spark, FOLDER)
    store = CustomerStore(t, space, n_buckets=4)
    own = {
        "master": (store.master, t.master, 5),
        "everyone": (store.everyone, t.everyone, 3),
        "everyone_engaged": (store.everyone_engaged, t.everyone_engaged, 2),
        "participants": (store.participants, t.participants, 1),
        "profiles": (store.profiles, t.profiles, 2),
        "participant_orders": (store.participant_orders, t.participant_orders, 2),
        "engagement": (store.engagement, t.engagement, 1),
    }
    for name, (found, expected, tables) in own.items():
        text = plan(found)
        assert "Exchange" not in text, name
        # Spark reads the files of a single table as it likes
        assert text.count("FileScan") == tables and text.count("Bucketed: true") in (tables, tables == 1 and 0), name
        common = [c for c in found.columns if c in expected.columns]
        assert set(expected.columns) - set(common) == set(), name
        assert rows(found.select(common)) == rows(expected), name
    assert rows(store.activity.select(ID, *(F.array_join(c, ",").alias(c) for c in ("participated", "engaged")))) == rows(
        t.activity.select(ID, *(F.array_join(c, ",").alias(c) for c in ("participated", "engaged")))
    )
    # a report by customer needs none either
    assert "Exchange" not in plan(store.master.groupBy(ID).agg(F.max("max_streak")))


def test_each_source_is_read_once(spark, space, monkeypatch):
    read = {}
    keep = Workspace.by_customer

    def noted(self, name, df, n_buckets):
        names = {re.search(r"/(\w+)(\.parquet)?(/part-[^/]*)?$", f)[1] for f in df.inputFiles()}
        read[name] = plan(df).count("FileScan"), names
        return keep(self, name, df, n_buckets)

    monkeypatch.setattr(Workspace, "by_customer", noted)
    CustomerStore(Tables(spark, FOLDER), space, n_buckets=2).master.count()
    assert read == {
        "engagement": (1, {"events"}),
        "coupons": (1, {"events"}),
        "orders": (2, {"orders", "lineitem"}),
        "customers": (2, {"customer", "nation"}),
        "ids": (4, set(SOURCES)),
    }


def test_customers_with_undated_or_no_rows(spark, space):
    """Ids of rows outside every period and window are customers too; null ids are none."""
    spec = CampaignSpec(date(2024, 12, 3), date(2024, 12, 24))
    periods = PeriodSpec(date(2023, 12, 1), spec.start, spec.end, date(2025, 12, 31))
    day = datetime(2024, 12, 3, 1)
    log = [("a", day, 1, "participate", None, 2), ("b", None, 2, "participate", None, 9), (None, day, 3, "enter", None, 0),
           ("c", datetime(2024, 12, 25), 4, "participate", None, 7)]
    orders = [("d", "o1", None, 5.0, 0.0, None), ("a", "o2", datetime(2024, 1, 1), 2.0, 1.0, "T1"), (None, "o3", day, 1.0, 0.0, None)]
    coupons = [("e", "issued", "T1", day, 1.5, "Fixed"), (None, "issued", "T1", day, 1.5, "Fixed")]
    people = [("f", "V"), ("a", "M"), (None, "V")]
    t = SimpleNamespace(
        campaign=spec, periods=periods,
        log=spark.createDataFrame(log, f"{ID} STRING, timestamp TIMESTAMP_NTZ, event_id LONG, event STRING, action STRING, current_streak_value INT"),
        coupons=spark.createDataFrame(coupons, f"{ID} STRING, event_type STRING, code STRING, timestamp TIMESTAMP_NTZ, value DOUBLE, value_type STRING"),
        orders_history_discounts=spark.createDataFrame(orders, f"{ID} STRING, order_id STRING, order_local_timestamp TIMESTAMP_NTZ, demand DOUBLE, coupon_discount DOUBLE, coupon_code STRING"),
        customers=spark.createDataFrame(people, f"{ID} STRING, gender STRING"),
    )
    store = CustomerStore(t, space, n_buckets=3)
    found = {r[ID]: r for r in store.master.collect()}
    assert sorted(found) == list("abcdef")
    assert [found[c].max_streak for c in "abc"] == [2, 0, 0] and found["c"].n_interactions == 0
    assert found["a"].n_orders_pre == 1 and found["d"].n_orders_pre == found["d"].total_orders_all_time == 0
    assert found["e"].has_coupon and not found["f"].has_coupon and found["f"].has_customer_info
    assert [r[ID] for r in retention.cohorts_of(store.activity, spec).collect()] == ["a"]
    assert [r[ID] for r in store.engagement.collect()] == ["a"]


def arguments(exports, out, *more):  # noqa: F811
    argv = [f"--{n}={exports}/{n}.csv" for n in ("log", "coupons", "transactions", "customers")]
    return [*argv, f"--out={out}", "--start=2024-12-03", "--end=2024-12-24", "--pre-start=2023-12-01",
            "--post-end=2025-12-31", "--id-prefix=shop:", "--reward-code=T", *more]


def test_reports_read_the_kept_exports_only(spark, exports, space):  # noqa: F811
    campaign = CampaignSpec(date(2024, 12, 3), date(2024, 12, 24), tiers=numbered_tiers("T"), code_marker="T")
    periods = PeriodSpec(date(2023, 12, 1), campaign.start, campaign.end, date(2025, 12, 31))
    paths = {n: f"{exports}/{n}.csv" for n in ("log", "coupons", "transactions", "customers")}
    t = run.read_exports(spark, paths, campaign, periods, "shop:", space=space)
    assert {"log_export", "coupons_export", "transactions_export", "customers_export"} <= space.done.keys()
    for name in ("funnel_sequential", "engagement_summary", "customer360", "daily_orders", "key_overlap",
                 "null_scrub", "hourly_orders", "segment_gender", "reward_selection", "source_rejects"):
        text = catalog.analyses()[name](t)._jdf.queryExecution().toString()
        assert "FileScan csv" not in text and ".csv" not in text, name
    assert "export_day" in plan(t.camp).split("PartitionFilters")[1]
    days = {d for d in os.listdir(space.path("log_export")) if d.startswith("export_day=")}
    assert "export_day=2024-12-03" in days and len(days) > 8
    assert rows(t.raw_log) == rows(run.readers.read_raw_log(spark, paths["log"]))


def test_a_failed_run_goes_on(spark, exports, tmp_path, monkeypatch):  # noqa: F811
    out = str(tmp_path / "reports")
    argv = arguments(exports, out, "--only", "funnel_independent", "cohort_sizes", "id_summary")
    every = catalog.analyses()
    ran, fail = [], [True]

    def noted(name):
        def build(t):
            if name == "cohort_sizes" and fail[0]:
                raise RuntimeError("lost")
            ran.append(name)
            return every[name](t)

        return build

    monkeypatch.setattr(run, "analyses", lambda: {n: noted(n) for n in every})
    monkeypatch.setattr(run, "shared_root", lambda spark, folder: str(tmp_path))
    parsed = []
    read = run.readers.read_checked
    monkeypatch.setattr(run.readers, "read_checked", lambda *a: (parsed.append(a[2]), read(*a))[1])
    with pytest.raises(RuntimeError, match="lost"):
        run.main(argv)
    fail[0] = False
    run.main(argv)
    assert ran == ["funnel_independent", "cohort_sizes", "id_summary"] and parsed == ["log", "coupons", "transactions", "customers"]
    assert not [f for f in os.listdir(tmp_path) if f.startswith("streakline_")]
    assert not [d for d in spark.catalog.listDatabases() if d.name.startswith(f"streakline_{run.run_name(argv)}")]
    # nothing is left of the run, so the same arguments start anew
    run.main(argv)
    assert ran[3:] == ran[:3]


def test_buckets_are_found_again_by_a_new_session(spark, tmp_path):
    t = Tables(spark, FOLDER)
    first = Workspace(spark, str(tmp_path), "again")
    wanted = rows(first.by_customer("coupons", profile.coupon_summary(t.coupons), 3))
    spark.sql(f"DROP TABLE {first.database}.coupons")  # external: the files stay, as for a new session
    second = Workspace(spark, str(tmp_path), "again")
    found = second.by_customer("coupons", None, 3)
    assert rows(found) == wanted and "Exchange" not in plan(found.groupBy(ID).agg(F.count("*")))
    second.close()


def test_local_folders_are_refused_on_a_cluster():
    def session(master, default, root=None):
        hadoop = SimpleNamespace(get=lambda key: default)
        context = SimpleNamespace(master=master, _jsc=SimpleNamespace(hadoopConfiguration=lambda: hadoop))
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, other: root), sparkContext=context)

    assert shared_root(session("yarn", "file:///", "hdfs://x/a/")) == "hdfs://x/a"
    assert shared_root(session("yarn", "hdfs://x"), "/out/_shared") == "/out/_shared"
    assert shared_root(session("yarn", "file:///"), "s3a://b/c/") == "s3a://b/c"
    for folder in (None, "/out", "file:///out"):
        with pytest.raises(ValueError, match="share"):
            shared_root(session("yarn", "file:///"), folder)
    assert shared_root(session("local[2]", "file:///"), "/out") == "/out"
