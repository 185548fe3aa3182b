"""Profiling and consistency checks of the campaign tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streakline.functions.dates import in_window, local_time
from streakline.functions.nulls import share
from streakline.functions.quantiles import column_percentiles
from streakline.operators.events import campaign_window, is_action, is_participation
from streakline.sources.cleaning import numeric_columns
from streakline.spec import ID, CampaignSpec

Tables = Mapping[str, DataFrame]


def _stack(rows: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rows)


def _per_table(tables: Tables, *aggs: Column) -> DataFrame:
    """One aggregate row per table, under the table's name."""
    return _stack([df.agg(*aggs).select(F.lit(name).alias("table"), "*") for name, df in tables.items()])


def scan_summary(tables: Tables) -> DataFrame:
    """Rows and columns of every source."""
    return _stack(
        [
            df.agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(name).alias("table"), "n_rows", F.lit(len(df.columns)).alias("n_columns")
            )
            for name, df in tables.items()
        ]
    )


def hourly_orders(transactions: DataFrame) -> DataFrame:
    """Orders per hour of day."""
    return (
        transactions.groupBy(F.hour("order_local_timestamp").alias("hour"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("hour")
    )


def hourly_boundary(transactions: DataFrame, days: Sequence[date]) -> DataFrame:
    """Orders per day and hour on chosen days, such as those around a clock change."""
    ts = F.col("order_local_timestamp")
    near = in_window(transactions, "order_local_timestamp", min(days), max(days))
    return (
        near.filter(F.to_date(ts).isin(*days))
        .groupBy(F.to_date(ts).alias("date"), F.hour(ts).alias("utc_hour"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("date", "utc_hour")
    )


def day_completeness(transactions: DataFrame, hours: int = 24) -> DataFrame:
    """Days on which not every hour has an order."""
    ts = F.col("order_local_timestamp")
    return (
        transactions.groupBy(F.to_date(ts).alias("date"))
        .agg(
            F.countDistinct(F.hour(ts)).alias("unique_hours"),
            F.count(F.lit(1)).alias("total_orders"),
        )
        .filter(F.col("unique_hours") != hours)
        .orderBy("unique_hours", "date")
    )


def time_ranges(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """First and last time of every table, given with its time column."""
    return _stack(
        [
            df.agg(F.min(ts).alias("min_time"), F.max(ts).alias("max_time")).select(
                F.lit(name).alias("table"), "*"
            )
            for name, (df, ts) in tables.items()
        ]
    )


def qualifying_range(log: DataFrame, spec: CampaignSpec) -> DataFrame:
    """First and last day with a participation or an opened card, in the whole log."""
    return log.filter(is_participation(spec) | is_action(spec, spec.opened)).agg(
        F.to_date(F.min("timestamp")).alias("first_day"),
        F.to_date(F.max("timestamp")).alias("last_day"),
    )


def daily_events_pivot(log: DataFrame, events: Sequence[str]) -> DataFrame:
    """Distinct customers per day, one column per event.

    The log is reduced to day, event and customer first; with the event list
    given, the pivot needs no pass to find it.
    """
    distinct = log.select(F.to_date("timestamp").alias("date"), "event", ID).distinct()
    return (
        distinct.groupBy("date")
        .agg(*[F.count_if(F.col("event") == e).alias(e) for e in events])
        .orderBy("date")
    )


def missing_ids(tables: Tables) -> DataFrame:
    """Rows without a customer id per table."""
    return _per_table(tables, F.count_if(F.col(ID).isNull()).alias("missing_ids"))


def id_summary(tables: Tables) -> DataFrame:
    """Distinct customers per table."""
    return _per_table(tables, F.countDistinct(ID).alias("unique_customers"))


def row_counts(tables: Tables) -> DataFrame:
    """Rows and distinct customers of intermediate tables."""
    return _per_table(
        tables, F.count(F.lit(1)).alias("n_rows"), F.countDistinct(ID).alias("unique_customers")
    )


def id_prefix_share(customers: DataFrame, prefix: str) -> DataFrame:
    """Share of ids that carry the tenant prefix."""
    return customers.agg(share(F.col(ID).startswith(prefix)).alias("prefix_share"))


def id_length_distribution(tables: Tables) -> DataFrame:
    """Ids per length and table."""
    return _stack(
        [
            df.groupBy(F.length(F.col(ID).cast("string")).alias("id_length"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit(name).alias("table"), "id_length", "n")
            for name, df in tables.items()
        ]
    )


def key_presence(tables: Tables) -> DataFrame:
    """One row per id with a flag per table.

    All tables are tagged, stacked and reduced by id in one shuffle, which
    answers every overlap question at once.
    """
    names = list(tables)
    tagged = [
        df.select(
            F.col(ID).cast("string").alias(ID), *[F.lit(n == name).alias(n) for n in names]
        ).filter(F.col(ID).isNotNull())
        for name, df in tables.items()
    ]
    return _stack(tagged).groupBy(ID).agg(*[F.bool_or(n).alias(n) for n in names])


def key_overlap(presence: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Number of ids two tables share, per pair."""
    counts = presence.agg(
        *[F.count_if(F.col(a) & F.col(b)).alias(f"{a}:{b}") for a, b in pairs]
    )
    rows = [
        F.struct(
            F.lit(a).alias("left_table"),
            F.lit(b).alias("right_table"),
            F.col(f"{a}:{b}").alias("shared_ids"),
        )
        for a, b in pairs
    ]
    return counts.select(F.inline(F.array(*rows)))


def common_customers(presence: DataFrame, first: int | None = None) -> DataFrame:
    """Ids present in every table; the lowest ``first`` of them if given."""
    tables = [c for c in presence.columns if c != ID]
    everywhere = reduce(lambda a, b: a & b, [F.col(t) for t in tables])
    ids = presence.filter(everywhere).select(ID)
    return ids if first is None else ids.orderBy(ID).limit(first)


def customer_timeline(
    ids: DataFrame,
    log: DataFrame,
    coupons: DataFrame,
    transactions: DataFrame,
    salts: int | None = None,
) -> DataFrame:
    """What the given customers did, from all three tables, one row per record.

    This is the one join that meets raw records. Customers with more than one ``salts``-th
    of all records, of which there are fewer than ``salts``, by default the number of shuffle
    partitions, are found first; their records are spread over that many join keys and only
    their ids repeated, so a customer with a third of all records does not end up in one
    task and the ids stay about as many as they are.
    """

    def part(df: DataFrame, source: str, what: Column, detail: Column, ts: str) -> DataFrame:
        return df.select(
            F.col(ID).cast("string").alias(ID),
            F.lit(source).alias("source"),
            what.alias("what"),
            detail.alias("detail"),
            F.col(ts).alias("timestamp"),
        )

    records = _stack(
        [
            part(log, "log", F.col("event"), F.col("action"), "timestamp"),
            part(coupons, "coupons", F.col("event_type"), F.col("code"), "timestamp"),
            part(
                transactions,
                "transactions",
                F.col("order_id").cast("string"),
                F.format_string("%.6f", F.col("demand").cast("double")),
                "order_local_timestamp",
            ),
        ]
    )
    salts = salts or int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = heavy_customers(records, salts)
    spread = F.pmod(F.xxhash64("timestamp", "source", "what"), F.lit(salts)).cast("int")
    salted = records.withColumn("_heavy", heavy.scalar())
    is_heavy = F.array_contains("_heavy", F.col(ID))
    salted = salted.withColumn("_salt", F.when(is_heavy, spread).otherwise(0)).drop("_heavy")
    return salted.join(salted_ids(ids, heavy, salts), [ID, "_salt"], "left_semi").drop("_salt")


def heavy_customers(records: DataFrame, parts: int) -> DataFrame:
    """One row: the ids, as text, of customers with more than one ``parts``-th of all
    records. There are fewer than ``parts`` of them, however many customers there are."""
    counts = records.filter(F.col(ID).isNotNull()).groupBy(ID).agg(F.count(F.lit(1)).alias("n"))
    every = counts.agg(F.sum("n").alias("n")).scalar()
    heavy = counts.withColumn("_all", every).filter(F.col("n") * parts > F.col("_all"))
    return heavy.agg(F.sort_array(F.collect_list(ID)).alias("heavy"))


def salted_ids(ids: DataFrame, heavy: DataFrame, salts: int) -> DataFrame:
    """The ids, those of heavy customers once for each salt."""
    text = ids.select(F.col(ID).cast("string").alias(ID)).withColumn("_heavy", heavy.scalar())
    own = F.when(F.array_contains("_heavy", F.col(ID)), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return text.select(ID, F.explode(own).alias("_salt"))


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values of each column, NULL included."""
    return _stack(
        [
            df.select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")).distinct()
            for c in columns
        ]
    )


def freq_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per value of each column, NULL being a value."""
    return _stack(
        [
            df.groupBy(F.col(c).cast("string").alias("value"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit(c).alias("column"), "value", "n")
            for c in columns
        ]
    )


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Minimum, quartiles, mean, maximum and NULL count of numeric columns, by default all but
    the id."""
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    return column_percentiles(df, columns or [c for c in numeric_columns(df) if c != ID], probs).select(
        "column", "n", "n_null", "minimum", "q1", "median", "mean", "q3", "maximum"
    )


def non_null_share(events: DataFrame, column: str, spec: CampaignSpec) -> DataFrame:
    """Share of participations in which ``column`` is filled."""
    return events.filter(is_participation(spec)).agg(
        share(F.col(column).isNotNull()).alias("non_null_share")
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key combinations that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def join_fanout_check(base: DataFrame, right_tables: Tables) -> DataFrame:
    """Rows before and after left-joining each table by customer id.

    A table whose id repeats makes the count grow; none of them should. The
    right side is reduced to one row per id with its multiplicity, so even a
    heavy id cannot blow up the check itself.
    """
    checks = []
    for name, right in right_tables.items():
        copies = right.groupBy(ID).agg(F.count(F.lit(1)).alias("copies"))
        checks.append(
            base.select(ID)
            .join(copies, ID, "left")
            .agg(
                F.count(F.lit(1)).alias("rows_before"),
                F.sum(F.coalesce("copies", F.lit(1))).alias("rows_after"),
                F.count_if(F.col("copies") > 1).alias("repeated_keys"),
            )
            .select(F.lit(name).alias("joined"), "*")
        )
    return _stack(checks)


def events_per_user(events: DataFrame) -> DataFrame:
    """Engagement events per customer."""
    return events.groupBy(ID).agg(F.count(F.lit(1)).alias("n"))


def tz_compare(df: DataFrame, key: str, ts: str, timezone: str) -> DataFrame:
    """Times as logged next to the same times in ``timezone``."""
    return df.select(
        key, F.col(ts).alias("original"), local_time(F.col(ts), timezone).alias("localised")
    )


def window_rows(log: DataFrame, spec: CampaignSpec) -> DataFrame:
    """Events per kind and action inside the campaign window."""
    return (
        campaign_window(log, spec)
        .groupBy("event", "action")
        .agg(F.count(F.lit(1)).alias("n"))
    )
