"""The campaign tables derived from a folder of TPC-H-like parquet tables.

``events`` plays the app log and the coupon log, its purchases play orders
during the campaign, ``orders`` with ``lineitem`` plays the long order history,
and ``customer`` with ``nation`` plays the attribute table. Raw tables carry
the defects the cleaning operators are for: ``'null'`` texts, negative streaks
and prefixed ids.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streakline.plans.tables import CampaignTables
from streakline.sources import schemas
from streakline.sources.cleaning import strip_id_prefix, typed_customers
from streakline.sources.readers import checked, clean_log
from streakline.spec import ID, CampaignSpec, PeriodSpec, numbered_tiers, scheduled_rewards

CAMPAIGN = CampaignSpec(
    start=date(2024, 1, 5),
    end=date(2024, 1, 26),
    enter="view",
    onboard="signup",
    participate="click",
    interaction=("purchase", "error"),
    tiers=numbered_tiers("TIER"),
    code_marker="TIER",
)
PERIODS = PeriodSpec(
    pre_start=date(1995, 1, 1),
    start=date(1998, 1, 1),
    end=date(1998, 12, 31),
    post_end=date(2001, 8, 1),
)
ORDER_DAYS = (date(2024, 1, 1), date(2024, 1, 30))
CHECK_DAYS = (date(2024, 1, 14), date(2024, 1, 15), date(2024, 1, 16))
ID_PREFIX = "Customer#"
EVENTS = ("click", "error", "purchase", "signup", "view")
TIER_CODE = "concat('TIER', k % 5 + 1)"


@dataclass
class Tables(CampaignTables):
    """Lazy campaign tables over one folder."""

    spark: SparkSession
    folder: str

    campaign = CAMPAIGN
    periods = PERIODS
    id_prefix = ID_PREFIX
    event_names = EVENTS
    order_days = ORDER_DAYS
    check_days = CHECK_DAYS
    reward_plan = scheduled_rewards(CAMPAIGN.start)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def _events(self) -> DataFrame:
        """Events with the number ``k`` of their properties and the reward code it stands for."""
        return self._read("events").selectExpr(
            f"user_id AS {ID}",
            "ts",
            "event_id",
            "event_type",
            "value",
            "try_cast(get_json_object(props, '$.k') AS INT) AS k",
        )

    @cached_property
    def raw_log(self) -> DataFrame:
        """Event log as exported: text streaks, missing values spelled ``null``."""
        return self._events.selectExpr(
            ID,
            "ts AS timestamp",
            "event_id",
            "event_type AS event",
            """CASE WHEN event_type = 'error' THEN 'opened'
                    WHEN event_type = 'purchase' THEN if(k % 2 = 0, 'claimed', 'selected')
                    ELSE 'null' END AS action""",
            """CASE WHEN k % 13 = 12 THEN 'null' WHEN k % 11 = 10 THEN '-1'
                    ELSE cast(k % 23 AS STRING) END AS current_streak_value""",
            """if(event_type IN ('click', 'purchase', 'error'),
                  element_at(array('coupon', 'win', 'tip', 'streak'), k % 4 + 1),
                  'null') AS collectable_type""",
            f"""if(event_type = 'purchase' AND k % 2 = 1, {TIER_CODE}, 'null')
                AS collectable_value""",
        )

    @cached_property
    def log(self) -> DataFrame:
        return clean_log(self.raw_log)

    @cached_property
    def coupons(self) -> DataFrame:
        return self._events.filter("event_type = 'purchase'").selectExpr(
            ID,
            "event_type",
            f"{TIER_CODE} AS code",
            "ts AS timestamp",
            "value",
            "if(k % 2 = 0, 'Percentage', 'Fixed') AS value_type",
        )

    @cached_property
    def orders_live(self) -> DataFrame:
        """Orders placed during the months of the campaign, a tenth off with a coupon."""
        return self._events.filter("event_type = 'purchase'").selectExpr(
            ID,
            "event_id AS order_id",
            "ts AS order_local_timestamp",
            "value AS demand",
            "if(k % 3 = 0, round(rint(value * 100) / 1000D, 2), 0D) AS coupon_discount",
            f"if(k % 3 = 0, {TIER_CODE}, NULL) AS coupon_code",
        )

    @cached_property
    def _orders(self) -> DataFrame:
        return self._read("orders").selectExpr(
            f"o_custkey AS {ID}",
            "o_orderkey AS order_id",
            "o_orderdate AS order_local_timestamp",
            "o_totalprice AS demand",
            "o_orderpriority",
        )

    @cached_property
    def orders_history(self) -> DataFrame:
        """The long order history, without discounts: no report but coupon use needs them."""
        return self._orders.drop("o_orderpriority")

    @cached_property
    def orders_history_discounts(self) -> DataFrame:
        """The long order history with the discount given on the order's lines, in whole cents."""
        per_order = (
            self._read("lineitem")
            .groupBy(F.col("l_orderkey").alias("order_id"))
            .agg(
                F.expr(
                    """round(sum(cast(rint(l_extendedprice * 100) AS BIGINT)
                             * cast(rint(l_discount * 100) AS BIGINT)) / 10000D, 2)"""
                ).alias("discount")
            )
        )
        return self._orders.join(per_order, "order_id", "left").selectExpr(
            ID,
            "order_id",
            "order_local_timestamp",
            "demand",
            "coalesce(discount, 0D) AS coupon_discount",
            "if(discount > 0, o_orderpriority, NULL) AS coupon_code",
        )

    @cached_property
    def raw_customers(self) -> DataFrame:
        """Attributes as exported: prefixed ids and numbers as text."""
        nation = self._read("nation").select("n_nationkey", "n_name", "n_regionkey")
        return (
            self._read("customer")
            .join(nation, F.expr("c_nationkey = n_nationkey"), "left")
            .selectExpr(
                f"c_name AS {ID}",
                """CASE WHEN c_custkey % 37 = 0 THEN 'Vrouw' WHEN c_custkey % 41 = 0 THEN 'm'
                        WHEN c_custkey % 3 = 0 THEN 'V' WHEN c_custkey % 3 = 1 THEN 'M'
                        END AS gender""",
                """CASE WHEN c_custkey % 19 = 0 THEN 'null' WHEN c_custkey % 23 = 0 THEN '110-114'
                        WHEN c_custkey % 43 = 0 THEN '18-20' WHEN c_custkey % 47 = 0 THEN '20-29'
                        ELSE concat(15 + 5 * (c_custkey % 18), '-', 19 + 5 * (c_custkey % 18))
                        END AS age""",
                "n_name AS province",
                "if(c_custkey % 17 = 0, 'null', cast(c_custkey % 12 AS STRING)) AS orders",
                """CASE c_custkey % 3 WHEN 0 THEN 'app' WHEN 1 THEN 'mobile' ELSE 'desktop' END
                   AS most_used_device""",
                "if(c_custkey % 2 = 0, 'android', 'ios') AS most_used_platform",
                "c_mktsegment AS most_popular_category",
                """if(c_custkey % 31 = 0, 'null', cast(n_regionkey + 1 AS STRING))
                   AS urbanisation""",
                """if(c_custkey % 29 = 0, 'null', cast(2010 + c_custkey % 15 AS STRING))
                   AS first_order_year""",
            )
        )

    @cached_property
    def exports(self) -> dict[str, DataFrame]:
        """The four exports as text with the spellings and defects of real ones, checked."""
        utc = "cast(timestamp AS STRING)"
        shifted = lambda hours: f"cast(timestamp + INTERVAL {hours} HOURS AS STRING)"
        local = "cast(convert_timezone('UTC', 'Europe/Amsterdam', timestamp) AS STRING)"
        log = self.raw_log.selectExpr(
            f"if(event_id % 89 = 0, 'null', cast({ID} AS STRING)) AS {ID}",
            f"""CASE WHEN event_id % 101 = 0 THEN 'soon' ELSE CASE event_id % 8
                WHEN 0 THEN {utc} WHEN 1 THEN concat({utc}, 'Z') WHEN 2 THEN concat({utc}, 'z')
                WHEN 3 THEN concat({shifted(2)}, '+02:00') WHEN 4 THEN concat({shifted(2)}, '+02')
                WHEN 5 THEN concat({shifted(-5)}, '-0500') WHEN 6 THEN concat({local}, ' Europe/Amsterdam')
                ELSE concat({local}, ' CET') END END AS timestamp""",
            "if(event_id % 97 = 0, concat('#', event_id), cast(event_id AS STRING)) AS event_id",
            *(c for c in self.raw_log.columns if c not in (ID, "timestamp", "event_id")),
        )
        coupons = self._events.filter("event_type = 'purchase'").selectExpr(
            f"cast({ID} AS STRING) AS {ID}",
            "event_type",
            f"{TIER_CODE} AS code",
            "cast(ts AS STRING) AS timestamp",
            "if(event_id % 23 = 0, '5 euro', cast(value AS STRING)) AS value",
            "if(k % 2 = 0, 'Percentage', 'Fixed') AS value_type",
        )
        transactions = self.orders_live.selectExpr(
            f"cast({ID} AS STRING) AS {ID}",
            "cast(order_id AS STRING) AS order_id",
            "cast(order_local_timestamp AS STRING) AS order_local_timestamp",
            "if(order_id % 19 = 0, '1,5', cast(demand AS STRING)) AS demand",
            "cast(coupon_discount AS STRING) AS coupon_discount",
            "coupon_code",
        )
        blank = F.substring_index(ID, "#", -1).cast("int") % 53 == 0
        customers = self.raw_customers.withColumn(ID, F.when(blank, F.lit(" ")).otherwise(F.col(ID)))
        raw = {"log": log, "coupons": coupons, "transactions": transactions, "customers": customers}
        return {n: checked(df, schemas.EXPORTS[n], schemas.TYPED_LATER.get(n, "")) for n, df in raw.items()}

    @cached_property
    def customers(self) -> DataFrame:
        """Clean attributes under the id type of the log."""
        return typed_customers(strip_id_prefix(self.raw_customers, ID_PREFIX, "bigint"))
