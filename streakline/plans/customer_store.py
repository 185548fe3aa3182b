"""Per-customer tables in buckets, and the reports' inputs joined from them.

Each source is read once and reduced to one row a customer. The rows lie in buckets by
customer, the same number for all tables, so the customer table and its narrower relatives
are joins without a shuffle, of the columns that a report asks for.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streakline.functions import bits
from streakline.operators import profile
from streakline.plans.workspace import Workspace
from streakline.spec import ID

if TYPE_CHECKING:
    from streakline.plans.tables import CampaignTables

DAY_SETS = ("participated", "engaged")
SOURCES = ("engagement", "coupons", "orders", "customers")


@dataclass
class CustomerStore:
    source: CampaignTables
    space: Workspace
    n_buckets: int = 0

    def __post_init__(self) -> None:
        default = self.space.spark.conf.get("spark.sql.shuffle.partitions")
        self.n_buckets = self.n_buckets or int(default)

    def _bucketed(self, name: str, df: DataFrame) -> DataFrame:
        return self.space.by_customer(name, df, self.n_buckets)

    # --- one table a source

    @cached_property
    def everyone_logged(self) -> DataFrame:
        """Every customer of the log, with engagement and days inside the campaign."""
        t = self.source
        return self._bucketed("engagement", profile.engagement_of_log(t.log, t.campaign))

    @cached_property
    def coupons(self) -> DataFrame:
        return self._bucketed("coupons", profile.coupon_summary(self.source.coupons))

    @cached_property
    def orders(self) -> DataFrame:
        t = self.source
        return self._bucketed("orders", profile.orders_by_customer(t.orders_history_discounts, t.periods))

    @cached_property
    def customers(self) -> DataFrame:
        return self._bucketed("customers", self.source.customers)

    @cached_property
    def ids(self) -> DataFrame:
        """Every customer, once."""
        for name in ("everyone_logged", "coupons", "orders", "customers"):
            getattr(self, name)
        # from the files, as a union of buckets does not keep them
        return self._bucketed("ids", profile.all_customer_ids([self.space.plain(n) for n in SOURCES]))

    # --- what reports read

    @property
    def engagement(self) -> DataFrame:
        """Customers with events inside the campaign."""
        return self.everyone_logged.filter("n_interactions > 0").drop(*DAY_SETS)

    @property
    def activity(self) -> DataFrame:
        """Days of the engaged customers, as bits."""
        days = self.source.campaign.days
        engaged = bits.size(bits.words(F.col("engaged"), days)) > 0
        return self.everyone_logged.filter(engaged).select(ID, *DAY_SETS)

    @property
    def everyone_engaged(self) -> DataFrame:
        return profile.attach_engagement(self.ids, self.everyone_logged.drop(*DAY_SETS))

    @property
    def everyone(self) -> DataFrame:
        slim = self.everyone_engaged.select(ID, "is_participant", "max_streak")
        return profile.attach_orders(slim, self.orders)

    @property
    def participants(self) -> DataFrame:
        return self.engagement.filter("is_participant")

    def _participants(self) -> DataFrame:
        return self.participants.select(ID, "n_opens", "n_claims", "max_streak")

    @property
    def profiles(self) -> DataFrame:
        return profile.attach_profile(self._participants(), self.customers)

    @property
    def participant_orders(self) -> DataFrame:
        return profile.attach_orders(self._participants(), self.orders)

    @property
    def master(self) -> DataFrame:
        """The full customer table."""
        with_profile = profile.attach_profile(self.ids, self.customers)
        engaged = profile.attach_engagement(with_profile, self.everyone_logged.drop(*DAY_SETS))
        return profile.attach_orders(profile.attach_coupons(engaged, self.coupons), self.orders)
