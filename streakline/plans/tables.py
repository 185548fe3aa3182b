"""The inputs of a campaign and the intermediate tables its analyses share."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession

from streakline.operators import activity, audit, distinct, events, profile, retention, rewards, streaks, timeofday
from streakline.plans import customer360 as c360
from streakline.plans.customer_store import CustomerStore
from streakline.plans.workspace import Workspace, shared_root
from streakline.sources import readers, schemas
from streakline.sources.cleaning import strip_id_prefix, typed_customers
from streakline.sources.readers import clean_log, reward_days, tier_table
from streakline.spec import CampaignSpec, PeriodSpec, RewardDay, scheduled_rewards


class CampaignTables:
    """Lazy shared tables over inputs that a subclass provides.

    A subclass gives ``spark``, ``campaign``, ``periods``, ``id_prefix``, ``event_names``, ``order_days``,
    ``check_days`` and ``reward_plan``, the ``checked`` ``exports``, and the
    frames ``raw_log``, ``log``, ``coupons``, ``orders_live``,
    ``orders_history``, ``orders_history_discounts``, ``raw_customers`` and
    ``customers``.
    """

    # --- reference tables of the campaign, a few rows each

    @cached_property
    def tiers(self) -> DataFrame:
        return tier_table(self.spark, self.campaign.tiers)

    @cached_property
    def rewards(self) -> DataFrame:
        return reward_days(self.spark, self.reward_plan)

    # --- what the exports hold that does not fit

    @property
    def reject_counts(self) -> DataFrame:
        """Values given and rejected, by export and column."""
        counts = [
            readers.reject_counts(df, schemas.EXPORTS[n], n, schemas.TYPED_LATER.get(n, ""))
            for n, df in self.exports.items()
        ]
        return reduce(DataFrame.unionByName, counts)

    @property
    def quarantine(self) -> DataFrame:
        """The rejected values with their records."""
        return reduce(DataFrame.unionByName, [readers.quarantine(df, n) for n, df in self.exports.items()])

    # --- shared steps

    @cached_property
    def camp(self) -> DataFrame:
        return events.campaign_window(self.log, self.campaign)

    @cached_property
    def engagement(self) -> DataFrame:
        return profile.engagement_summary(self.camp, self.campaign)

    @cached_property
    def ids(self) -> DataFrame:
        return profile.all_customer_ids(
            [self.log, self.coupons, self.orders_history, self.customers]
        )

    @cached_property
    def master(self) -> DataFrame:
        """The full customer table."""
        return c360.customer360(
            self.log,
            self.coupons,
            self.orders_history_discounts,
            self.customers,
            self.campaign,
            self.periods,
        )

    @cached_property
    def master_without_coupon_use(self) -> DataFrame:
        return c360.customer360(
            self.log, self.coupons, self.orders_history, self.customers, self.campaign, self.periods
        )

    @cached_property
    def everyone_engaged(self) -> DataFrame:
        """Every customer with engagement."""
        return c360.engagement_of_all(
            self.log, self.coupons, self.orders_history, self.customers, self.campaign
        )

    @cached_property
    def everyone(self) -> DataFrame:
        """Every customer with participation, streak and orders per period."""
        return c360.orders_of_all(
            self.log,
            self.coupons,
            self.orders_history,
            self.customers,
            self.campaign,
            self.periods,
        )

    @cached_property
    def participants(self) -> DataFrame:
        return c360.participants(self.log, self.campaign)

    @cached_property
    def profiles(self) -> DataFrame:
        """Participants with their attributes."""
        return c360.participant_profile(self.log, self.customers, self.campaign)

    @cached_property
    def participant_orders(self) -> DataFrame:
        return c360.participant_orders(
            self.log, self.orders_history, self.campaign, self.periods
        )

    @cached_property
    def max_streaks(self) -> DataFrame:
        return streaks.user_max_streak(self.camp, self.campaign)

    @cached_property
    def selection(self) -> DataFrame:
        return rewards.reward_selection(self.log, self.tiers, self.campaign)

    @cached_property
    def chosen(self) -> DataFrame:
        """Reward selectors with their streaks."""
        return rewards.selectors(self.selection, self.engagement)

    @cached_property
    def activity(self) -> DataFrame:
        """The campaign days of each engaged customer, as bits."""
        return activity.activity_bitmaps(self.log, self.campaign)

    @cached_property
    def store(self) -> CustomerStore:
        """Per-customer tables in buckets, written when first used."""
        return CustomerStore(self, Workspace(self.spark, shared_root(self.spark)))

    @cached_property
    def lifecycle(self) -> DataFrame:
        return retention.lifecycle_of(self.activity, self.campaign)

    @cached_property
    def local(self) -> DataFrame:
        """Participations in local time."""
        return timeofday.local_time_events(self.camp, self.campaign)

    @cached_property
    def participation_bitmaps(self) -> DataFrame:
        """Customers of each hour of participation, as bitmaps."""
        return distinct.customer_bitmaps(distinct.participation_hours(self.camp, self.campaign))

    @cached_property
    def gaps(self) -> DataFrame:
        return audit.streak_gap_analysis(audit.streak_audit(self.log, self.campaign))

    @cached_property
    def affected(self) -> DataFrame:
        """Rewards selected by customers with an inconsistent streak."""
        return audit.affected_selections(self.log, self.gaps, self.campaign)


@dataclass
class ExportTables(CampaignTables):
    """A campaign's own exports, as read by ``streakline.sources.readers``.

    ``transactions`` serves both the campaign and the history. Some forty reports stand on
    per-customer rows, so these are written once, in buckets by customer, to ``space``, by
    default a workspace of their own in the cluster's checkpoint folder. The reports join
    them without a shuffle, and a lost executor costs a file scan.
    """

    spark: SparkSession
    log: DataFrame
    raw_log: DataFrame
    coupons: DataFrame
    transactions: DataFrame
    raw_customers: DataFrame
    campaign: CampaignSpec
    periods: PeriodSpec
    id_prefix: str = ""
    check_days: tuple[date, ...] = ()
    reward_plan: tuple[RewardDay, ...] = ()
    margin_days: int = 13
    space: Workspace | None = None
    exports: dict[str, DataFrame] = field(default_factory=dict)
    event_names: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        c = self.campaign
        self.reward_plan = self.reward_plan or scheduled_rewards(c.start)
        self.event_names = self.event_names or (c.enter, c.onboard, c.participate, *c.interaction)
        self.check_days = self.check_days or (c.start, c.end)
        self.order_days = (
            c.start - timedelta(days=self.margin_days),
            c.end + timedelta(days=self.margin_days),
        )
        self.orders_live = self.orders_history = self.orders_history_discounts = self.transactions

    @cached_property
    def customers(self) -> DataFrame:
        return typed_customers(strip_id_prefix(self.raw_customers, self.id_prefix))

    @cached_property
    def store(self) -> CustomerStore:
        space = self.space or Workspace(self.spark, shared_root(self.spark))
        return CustomerStore(self, space)

    @cached_property
    def camp(self) -> DataFrame:
        """The events of the campaign; of a log that is kept by day only its days are read."""
        if self.space is None or "log_export" not in self.space.done:
            return super().camp
        c = self.campaign
        days = self.space.days("log_export", c.start, c.end).select(*self.raw_log.columns)
        return events.campaign_window(clean_log(days), c)

    @cached_property
    def participation_bitmaps(self) -> DataFrame:
        made = super().participation_bitmaps
        return made if self.space is None else self.space.once("participation_bitmaps", made)

    @property
    def ids(self) -> DataFrame:
        return self.store.ids

    @property
    def engagement(self) -> DataFrame:
        return self.store.engagement

    @property
    def activity(self) -> DataFrame:
        return self.store.activity

    @property
    def master(self) -> DataFrame:
        return self.store.master

    @property
    def master_without_coupon_use(self) -> DataFrame:
        return self.store.master

    @property
    def everyone_engaged(self) -> DataFrame:
        return self.store.everyone_engaged

    @property
    def everyone(self) -> DataFrame:
        return self.store.everyone

    @property
    def participants(self) -> DataFrame:
        return self.store.participants

    @property
    def profiles(self) -> DataFrame:
        return self.store.profiles

    @property
    def participant_orders(self) -> DataFrame:
        return self.store.participant_orders
