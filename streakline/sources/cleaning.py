"""Column-name, null, id and streak cleaning."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from streakline.functions.nulls import text_or_null
from streakline.spec import ID

_WORD_EDGE = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


def snake_case(name: str) -> str:
    """A header as a lower-case identifier; ``x`` stands in where no letter leads."""
    text = name.replace("%", " percent ").replace("#", " number ")
    text = _WORD_EDGE.sub(" ", text)
    text = "_".join(re.findall(r"[^\W_]+", text)).lower()
    return text if text[:1].isalpha() else f"x{text}"


def unique_names(names: Sequence[str]) -> list[str]:
    """Snake-case names, with _2, _3 ... appended to repeats."""
    seen: dict[str, int] = {}
    out = []
    for name in map(snake_case, names):
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def normalize_headers(df: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
    """Snake-case, unique column names, without the stray columns named in ``drop``."""
    return df.toDF(*unique_names(df.columns)).drop(*drop)


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def null_scrub(
    df: DataFrame, columns: Sequence[str] | None = None, missing: str = "null"
) -> DataFrame:
    """The missing-value marker as NULL in ``columns`` (default: every string column)."""
    names = string_columns(df) if columns is None else columns
    return df.withColumns({c: text_or_null(F.col(c), missing) for c in names})


def strip_id_prefix(df: DataFrame, prefix: str, id_type: str = "string") -> DataFrame:
    """Customer ids without a tenant prefix, cast to the id type of the other tables."""
    bare = F.regexp_replace(F.col(ID), f"^{re.escape(prefix)}", "")
    return df.withColumn(ID, bare if id_type == "string" else bare.try_cast(id_type))


def sanitize_streak(df: DataFrame, column: str = "current_streak_value") -> DataFrame:
    """Streak as an integer; missing, unreadable and negative values count as 0."""
    number = F.col(column).try_cast("double").try_cast("int")
    return df.withColumn(column, F.greatest(F.coalesce(number, F.lit(0)), F.lit(0)))


def typed_customers(df: DataFrame) -> DataFrame:
    """Customer attributes as numbers where they are numbers; text markers become NULL."""
    return null_scrub(df, ["urbanisation", "first_order_year", "orders"]).withColumns(
        {
            "urbanisation": F.col("urbanisation").try_cast("int"),
            "first_order_year": F.col("first_order_year").try_cast("int"),
            "orders": F.col("orders").try_cast("int"),
        }
    )
