"""Scans of the campaign exports, CSV or parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructType, TimestampNTZType

from streakline.sources import schemas
from streakline.sources.cleaning import (
    null_scrub,
    sanitize_streak,
    string_columns,
    strip_id_prefix,
    typed_customers,
    unique_names,
)
from streakline.spec import ID, RewardDay, RewardTier


def _ddl(ddl: str) -> StructType:
    return StructType.fromDDL(" ".join(ddl.split()))


#: Columns that every report of their table stands on.
REQUIRED = {ID, "timestamp", "event", "order_id", "order_local_timestamp", "demand"}
_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
_DATE = r"^\d{4}-\d{1,2}-\d{1,2}"
_TIME = r"[T ]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d{1,9})?)?"
#: Columns of a table that its typed values do not have: what was rejected, and the record.
REJECTS, RECORD, FILE, CORRUPT = "_rejects", "_record", "_file", "_corrupt_record"
REJECT = "struct<column:string,value:string>"


def utc_timestamp(text: Column) -> Column:
    """Text as UTC wall time; NULL where it is no date, or names a zone that there is not.

    A time without a zone is UTC. A zone may be ``Z``, an offset of hours, minutes and
    seconds in any usual spelling, a region or an abbreviation, after a space or not, or a
    region in brackets after an offset, which then decides. In a region, a time of the
    hour that clocks repeat is the earlier one, and a time of the hour that they skip is as
    many minutes after the change as it is past the start of that hour.
    """
    plain = F.regexp_replace(text, r"([+-][\d:]+|[zZ])\[[^\]]*\]$", "$1")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\[([^\]]*)\]$", "$1"), r"(?<=\d) ?z$", "Z")
    plain = F.regexp_replace(plain, r"([T ]\d{1,2}:\d{1,2})(?![\d:])", "$1:00")
    instant = F.call_function("unix_micros", plain.try_cast("timestamp"))
    moved = F.timestamp_add("MICROSECOND", instant, F.expr(_EPOCH))
    zoned = plain.rlike(f"{_DATE}{_TIME} *[^\\d.: ]")
    return F.when(plain.rlike(_DATE), F.when(zoned, moved).otherwise(plain.try_cast("timestamp_ntz")))


def typed(col: Column, source: DataType, wanted: DataType) -> Column:
    """``col`` in the wanted type; NULL where it does not fit."""
    if isinstance(source, StringType) and isinstance(wanted, TimestampNTZType):
        return utc_timestamp(F.trim(col))
    if isinstance(source, StringType) and not isinstance(wanted, StringType):
        return F.trim(col).try_cast(wanted)
    return col.try_cast(wanted)


def read_source(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    multi_line: bool = False,
    keep_malformed: bool = False,
) -> DataFrame:
    """A table as it is, under clean names, with the file of each row.

    CSV quotes inside a quoted value are doubled. ``multi_line`` allows line breaks
    inside quoted values; a file is then read by one task, so leave it off otherwise.
    ``keep_malformed`` keeps a line with too many or too few values beside the values that
    it has; all values of a line are then parsed, whichever are asked for.
    """
    file = F.col("_metadata.file_path").alias(FILE)
    if fmt != "csv":
        found = spark.read.format(fmt).load(path)
        return _named(found, file)
    options = {"header": True, "inferSchema": False, "escape": '"', "multiLine": multi_line}
    found = spark.read.options(**options).csv(path)
    if not keep_malformed:
        return _named(found, file)
    names = found.columns
    options |= {"columnNameOfCorruptRecord": CORRUPT, "columnPruning": False}
    schema = ", ".join(f"`{n.replace('`', '``')}` STRING" for n in [*names, CORRUPT])
    found = spark.read.options(**options).schema(schema).csv(path)
    return _named(found, file)


def _named(df: DataFrame, *more: Column) -> DataFrame:
    """``df`` under clean names, and the columns ``more``."""
    own = [n for n in df.columns if n != CORRUPT]
    kept = [F.col(f"`{n}`").alias(c) for n, c in zip(own, unique_names(own), strict=True)]
    return df.select(*kept, *(F.col(n) for n in df.columns if n == CORRUPT), *more)


def checked(raw: DataFrame, ddl: str, later: str = "", missing: str = "null") -> DataFrame:
    """The declared columns of ``raw`` with declared types, then what did not fit.

    Values that do not fit their type become NULL and are listed in ``_rejects`` by column,
    with the record as JSON in ``_record``; both are NULL for a row without any. ``later``
    declares the types of columns that stay text here. A customer id that is blank or the
    missing marker is a reject too, and so is a line with too many or too few values.
    """
    fields = _ddl(ddl).fields
    wanted = {f.name: f.dataType for f in fields} | {f.name: f.dataType for f in (_ddl(later).fields if later else ())}
    tests = []
    for name, kind in wanted.items():
        if name in raw.columns:
            col, source = F.col(name), raw.schema[name].dataType
            if name == ID:
                bad = ~given(col, source, missing)
            elif isinstance(kind, StringType):
                continue
            else:
                bad = given(col, source, missing) & typed(col, source, kind).isNull()
            tests.append(F.when(bad, F.struct(F.lit(name).alias("column"), col.cast("string").alias("value"))))
    if CORRUPT in raw.columns:
        line = F.struct(F.lit(CORRUPT).alias("column"), F.col(CORRUPT).alias("value"))
        tests.append(F.when(F.col(CORRUPT).isNotNull(), line))
    found = F.filter(F.array(*tests), lambda r: r.isNotNull()) if tests else F.array().cast(f"array<{REJECT}>")
    rejects = F.when(F.size(found) > 0, found)
    own = [c for c in raw.columns if c not in (CORRUPT, FILE)]
    return raw.select(
        *[
            typed(F.col(f.name), raw.schema[f.name].dataType, f.dataType).alias(f.name)
            if f.name in raw.columns
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in fields
        ],
        rejects.alias(REJECTS),
        F.when(rejects.isNotNull(), F.to_json(F.struct(*own))).alias(RECORD),
        (F.col(FILE) if FILE in raw.columns else F.lit(None).cast("string")).alias(FILE),
    )


def given(col: Column, source: DataType, missing: str = "null") -> Column:
    """Whether there is a value, and not the missing marker."""
    if isinstance(source, StringType):
        return F.coalesce(~F.trim(col).isin("", missing), F.lit(False))
    return col.isNotNull()


def _rejected(column: str) -> Column:
    return F.coalesce(F.array_contains(F.col(f"{REJECTS}.column"), column), F.lit(False))


def reject_measures(df: DataFrame, ddl: str, later: str = "", missing: str = "null") -> list[Column]:
    """Aggregates over ``checked`` rows, named n_values:column and n_rejected:column."""
    kinds = {f.name: f.dataType for f in _ddl(ddl).fields}
    kinds |= {f.name: f.dataType for f in (_ddl(later).fields if later else ())}
    out = []
    for name, kind in kinds.items():
        if isinstance(kind, StringType) and name != ID:
            continue
        bad = _rejected(name)
        value = F.lit(True) if name == ID else bad | given(F.col(name), df.schema[name].dataType, missing)
        out += [F.count_if(value).alias(f"n_values:{name}"), F.count_if(bad).alias(f"n_rejected:{name}")]
    broken = _rejected(CORRUPT)
    return [*out, F.count(F.lit(1)).alias(f"n_values:{CORRUPT}"), F.count_if(broken).alias(f"n_rejected:{CORRUPT}")]


def reject_counts(df: DataFrame, ddl: str, table: str, later: str = "", missing: str = "null") -> DataFrame:
    """(table, column, n_values, n_rejected) of ``checked`` rows: of each column that has a
    type the values that were given and those that did not fit, of ids the rows and those
    without one, and of ``_corrupt_record`` the rows and the malformed lines."""
    measures = reject_measures(df, ddl, later, missing)
    names = [f"{m}" for m in df.agg(*measures).columns if m.startswith("n_values:")]
    counts = [
        F.struct(
            F.lit(n.partition(":")[2]).alias("column"),
            F.col(f"`{n}`").alias("n_values"),
            F.col(f"`{n.replace('n_values', 'n_rejected')}`").alias("n_rejected"),
        )
        for n in names
    ]
    return df.agg(*measures).select(F.lit(table).alias("table"), F.inline(F.array(*counts)))


def quarantine(df: DataFrame, table: str) -> DataFrame:
    """(table, file, column, value, record): a row for each value of ``checked`` rows that
    did not fit."""
    return df.filter(F.col(REJECTS).isNotNull()).select(
        F.lit(table).alias("table"), F.col(FILE).alias("file"), F.col(RECORD).alias("record"), F.inline(REJECTS)
    ).select("table", "file", "column", "value", "record")


def read_checked(
    spark: SparkSession, path: str, table: str, fmt: str = "csv", multi_line: bool = False
) -> DataFrame:
    """One of the four exports with types, and with what did not fit in them."""
    named = read_source(spark, path, fmt, multi_line, keep_malformed=True)
    ddl = schemas.EXPORTS[table]
    _require(named, ddl, path)
    return checked(named, ddl, schemas.TYPED_LATER.get(table, ""))


def _require(named: DataFrame, ddl: str, path: str) -> None:
    missing = [f.name for f in _ddl(ddl).fields if f.name in REQUIRED and f.name not in named.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")


def read_table(
    spark: SparkSession, path: str, ddl: str, fmt: str = "csv", multi_line: bool = False
) -> DataFrame:
    """The declared columns of a table, under clean names and with declared types.

    Columns are matched by cleaned header, so their order and spelling in the file
    do not matter. A missing column that reports stand on is an error; other declared
    columns the file lacks come back as NULL. Values that do not fit their type become
    NULL; ``read_checked`` keeps them.
    """
    named = read_source(spark, path, fmt, multi_line)
    _require(named, ddl, path)
    return checked(named, ddl).drop(REJECTS, RECORD, FILE)


def source_rejects(raw: DataFrame, ddl: str, table: str, missing: str = "null") -> DataFrame:
    """``reject_counts`` of a table as it is, for its columns that are not text."""
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in _ddl(ddl).fields if f.name in raw.columns)
    counts = reject_counts(checked(raw, own, missing=missing), own, table, missing=missing)
    return counts.filter(~F.col("column").isin(ID, CORRUPT))


def read_log(
    spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = False
) -> DataFrame:
    """App event log, scrubbed and with a numeric streak.

    ``event_id`` orders events with equal timestamps; among those equal in both, and
    in a log without it, the higher streak counts as the later one.
    """
    return clean_log(read_raw_log(spark, path, fmt, multi_line))


def read_raw_log(
    spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = False
) -> DataFrame:
    """App event log as exported."""
    return read_table(spark, path, schemas.LOG, fmt, multi_line)


def clean_log(raw: DataFrame) -> DataFrame:
    """Missing markers as NULL and the streak as a number.

    ``event`` stays as it is: every event has a kind, and a bare column is what
    lets parquet skip row groups by it.
    """
    return sanitize_streak(null_scrub(raw, [c for c in string_columns(raw) if c != "event"]))


def read_coupons(
    spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = False
) -> DataFrame:
    return null_scrub(read_table(spark, path, schemas.COUPONS, fmt, multi_line))


def read_transactions(
    spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = False
) -> DataFrame:
    return read_table(spark, path, schemas.TRANSACTIONS, fmt, multi_line)


def read_customers(
    spark: SparkSession, path: str, fmt: str = "csv", id_prefix: str = "", multi_line: bool = False
) -> DataFrame:
    """Customer attributes with the tenant prefix taken off the id."""
    return typed_customers(strip_id_prefix(read_raw_customers(spark, path, fmt, multi_line), id_prefix))


def read_raw_customers(
    spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = False
) -> DataFrame:
    """Customer attributes as exported, numbers still as text."""
    return read_table(spark, path, schemas.CUSTOMERS, fmt, multi_line)


def tier_table(spark: SparkSession, tiers: Sequence[RewardTier]) -> DataFrame:
    """Reward code, streak tier and value: one row per tier of the campaign."""
    return spark.createDataFrame([(t.code, t.tier, t.value) for t in tiers], schemas.TIERS)


def reward_days(spark: SparkSession, days: Sequence[RewardDay]) -> DataFrame:
    """The reward calendar as a table: one row per campaign day."""
    return spark.createDataFrame(
        [
            (
                d.day,
                d.kind,
                d.description,
                d.code,
                int(d.flat_amount > 0),
                d.flat_amount,
                int(d.percentage_rate > 0),
                d.percentage_rate,
            )
            for d in days
        ],
        " ".join(schemas.REWARD_CALENDAR.split()),
    )
