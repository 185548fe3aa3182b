"""The campaign's plan from files, and reports that follow it."""

from datetime import date

import pytest
from test_run import exports  # noqa: F401

from streakline.plans.run import main
from streakline.sources.plan import read_reward_days, read_tiers
from streakline.spec import RewardDay, RewardTier


def given(folder, text):
    path = folder / "plan.csv"
    path.write_text(text)
    return str(path)


def test_calendar_is_read_in_the_order_of_its_days(spark, tmp_path):
    path = given(tmp_path, "Date,Type,Code,Flat Discount Amount,Percentage Rate\n"
                           "2024-12-05,win,,,\n2024-12-03,coupon,A1,5,\n2024-12-04,coupon,A2,,20\n")  # fmt: skip
    assert read_reward_days(spark, path) == (
        RewardDay(date(2024, 12, 3), "coupon", "A1", 5, 0),
        RewardDay(date(2024, 12, 4), "coupon", "A2", 0, 20),
        RewardDay(date(2024, 12, 5), "win"),
    )


def test_tiers_are_read_from_the_lowest(spark, tmp_path):
    path = given(tmp_path, "tier,value,code\n9,25,GOLD\n3,5,BRONZE\n")
    assert read_tiers(spark, path) == (RewardTier("BRONZE", 3, 5), RewardTier("GOLD", 9, 25))


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("code,tier\nA,1\n", "lacks the columns value"),
        ("code,tier,value\n", "between 1 and"),
        ("code,tier,value\nA,1,5\nA,2,6\n", "gives a code twice"),
        ("code,tier,value\nA,one,5\n", "tier 'one'"),
        ("code,tier,value\nA,1,\n", "no value"),
        ("code,tier,value\nA,1,5,6\n", "_corrupt_record"),
    ],
)
def test_tiers_that_are_wrong_are_refused(spark, tmp_path, text, message):
    with pytest.raises(ValueError, match=message):
        read_tiers(spark, given(tmp_path, text))


def test_reports_follow_the_plan(spark, exports, tmp_path):  # noqa: F811
    out = str(tmp_path / "reports")
    rewards = tmp_path / "rewards.csv"
    rewards.write_text("date,type,code,flat_discount_amount\n2024-12-03,coupon,X,7\n2024-12-04,tip,,\n")
    tiers = tmp_path / "tiers.csv"
    tiers.write_text("code,tier,value\nT1,4,40\nT2,8,80\n")
    argv = [f"--{n}={exports}/{n}.csv" for n in ("log", "coupons", "transactions", "customers")]
    main([*argv, f"--out={out}", "--start=2024-12-03", "--end=2024-12-24", "--pre-start=2023-12-01",
          "--post-end=2025-12-31", "--id-prefix=shop:", "--reward-code=T", f"--rewards={rewards}",
          f"--tiers={tiers}", "--margin-days=0", "--check-days", "2024-12-03",
          "--only", "reward_calendar", "tier_mapping", "daily_full"])
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    assert [(r.date.day, r.reward_label) for r in read("reward_calendar").orderBy("date").collect()] == [
        (3, "€ 7 off"), (4, "Tip day"),
    ]
    days = [r.order_date for r in read("daily_full").collect()]
    assert all(date(2024, 12, 3) <= d <= date(2024, 12, 24) for d in days)
    assert {(r["code"], r["tier"], r["value"]) for r in read("tier_mapping").collect()} >= {("T1", 4, 40), ("T2", 8, 80)}
