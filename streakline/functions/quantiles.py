"""Exact percentiles of columns with any number of distinct values.

``F.median`` and ``percentile`` keep every distinct value of a group in one
aggregation buffer. That is right for a streak between 0 and 22 and is what the
operators use there. Money per customer has as many values as customers, so
here the rank is found in two steps: count values per bucket, then order only
the buckets that hold a wanted rank.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 128
#: Ranks that a sketch of ``column_percentiles`` tells apart.
ACCURACY = 10_000
#: Values up to which a column is its own bracket.
WHOLE = 2 * ACCURACY


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    probs: Mapping[str, float],
    buckets: int = BUCKETS,
) -> DataFrame:
    """One row per ``keys`` with a linearly interpolated percentile per entry of ``probs``.

    NULL values are left out; a group of only NULLs has no row. Bucket limits
    come from a sketch and only balance the work: a bucket is a monotone
    function of the value, so the ranks are exact whatever the limits are. A
    value repeated in a third of the rows is one row after the first count.
    """
    keys = list(keys)
    counted = (
        df.select(*keys, value.cast("double").alias("_value"))
        .filter(F.col("_value").isNotNull())
        .groupBy(*keys, "_value")
        .agg(F.count(F.lit(1)).alias("_n"))
        # always true; keeps every use of this exchange identical so it is reused
        .filter(F.col("_n") > 0)
    )
    steps = [i / buckets for i in range(1, buckets)]
    limits = counted.filter(F.col("_n") > 0).agg(
        F.percentile_approx("_value", steps, 10 * buckets).alias("_limits")
    )
    placed = counted.withColumn("_limits", limits.scalar()).select(
        *keys,
        "_value",
        "_n",
        F.size(F.filter("_limits", lambda limit: limit < F.col("_value"))).alias("_bucket"),
    )

    # at most ``buckets`` rows per group from here on
    up_to = Window.partitionBy(*keys).orderBy("_bucket")
    whole = Window.partitionBy(*keys)
    totals = placed.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_n_bucket"))
    ranked = totals.withColumns(
        {
            "_start": F.sum("_n_bucket").over(up_to) - F.col("_n_bucket"),
            "_total": F.sum("_n_bucket").over(whole),
        }
    )
    # zero-based ranks next to the exact position, which may lie between two rows
    at = {name: f"((_total - 1) * {float(p)!r}D)" for name, p in probs.items()}
    low = {name: f"floor({position})" for name, position in at.items()}
    high = {name: f"ceil({position})" for name, position in at.items()}
    ranks = [*low.values(), *high.values()]
    hit = ranked.filter(
        " OR ".join(f"({r} >= _start AND {r} < _start + _n_bucket)" for r in ranks)
    ).selectExpr(*[f"{k} AS _k_{k}" for k in keys], "_bucket AS _b", "_start", "_total")

    same_bucket = " AND ".join(["_bucket = _b", *[f"{k} <=> _k_{k}" for k in keys]])
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_value")
    positions = placed.join(hit, F.expr(same_bucket)).withColumn(
        "_end", F.col("_start") + F.sum("_n").over(inside)
    )

    def value_at(rank: str, name: str) -> Column:
        return F.expr(f"max(if({rank} >= _end - _n AND {rank} < _end, _value, NULL)) AS {name}")

    found = positions.groupBy(*keys).agg(
        F.max("_total").alias("_total"),
        *[value_at(rank, f"_lo_{name}") for name, rank in low.items()],
        *[value_at(rank, f"_hi_{name}") for name, rank in high.items()],
    )
    return found.selectExpr(
        *keys,
        *[
            f"_lo_{name} + (_hi_{name} - _lo_{name}) * ({at[name]} - {low[name]}) AS {name}"
            for name in probs
        ],
    )


def column_percentiles(df: DataFrame, columns: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """A row a column: ``column``, n values, n_null, minimum, maximum and mean, and an exact,
    linearly interpolated percentile per entry of ``probs``.

    Two passes over ``df``, whatever the number of columns. The first counts, and sketches
    all columns; a sketch gives bounds that each wanted rank lies between. The second counts
    the values inside those bounds, some ten thousandths of a column, and the rows below
    them. Ranks that a sketch should have bracketed and has not are an error.
    """
    around = [x for p in probs.values() for x in (max(0.0, p - 2 / ACCURACY), min(1.0, p + 2 / ACCURACY))]

    def measured(name: str) -> Column:
        col = F.col(f"`{name}`")
        value = col.cast("double")
        total = F.sum(col.cast("decimal(28,6)")).cast("double")
        return F.struct(
            F.lit(name).alias("column"),
            F.count(col).alias("n"),
            F.count_if(col.isNull()).alias("n_null"),
            F.min(value).alias("minimum"),
            F.max(value).alias("maximum"),
            F.try_divide(total, F.count(col)).alias("mean"),
            F.percentile_approx(value, around, F.lit(ACCURACY)).alias("around"),
        )

    stats = df.agg(F.array(*[measured(c) for c in columns]).alias("stats"))
    bounds = F.transform(
        "stats",
        lambda s: F.transform(
            F.sequence(F.lit(0), F.lit(len(probs) - 1)),
            lambda q: F.struct(
                F.when(s["n"] < WHOLE, s["minimum"]).otherwise(F.get(s["around"], 2 * q)).alias("low"),
                F.when(s["n"] < WHOLE, s["maximum"]).otherwise(F.get(s["around"], 2 * q + 1)).alias("high"),
            ),
        ),
    )
    # one row of all columns; as a subquery it is worked out once, however often it is used
    first = stats.select(F.struct("stats", bounds.alias("bounds")).alias("first"))
    cells = []
    for i, name in enumerate(columns):
        value = F.col(f"`{name}`").cast("double")
        for q in range(len(probs)):
            bound = F.get(F.get("_first.bounds", F.lit(i)), F.lit(q))
            inside = F.when(value >= bound["low"], value)
            cell = F.struct(F.lit(name).alias("column"), F.lit(q).alias("q"), inside.alias("value"))
            cells.append(F.when(value <= bound["high"], cell))
    found = df.withColumn("_first", first.scalar()).select(
        F.inline(F.filter(F.array(*cells), lambda c: c.isNotNull()))
    )
    # the values of one bracket, after the rows below it
    counted = found.groupBy("column", "q", "value").agg(F.count(F.lit(1)).alias("n_equal"))
    upto = F.sum("n_equal").over(Window.partitionBy("column", "q").orderBy(F.asc_nulls_first("value")))
    placed = counted.withColumn("_end", upto).filter("value IS NOT NULL")
    own = F.filter("_first.stats", lambda s: s["column"] == F.col("column"))
    share = F.get(F.array(*[F.lit(float(p)) for p in probs.values()]), F.col("q"))
    ranked = placed.withColumn("_first", first.scalar()).withColumn("_at", (F.get(own, 0)["n"] - 1) * share)
    begin = F.col("_end") - F.col("n_equal")
    holds = lambda rank: F.max(F.when((rank >= begin) & (rank < F.col("_end")), F.col("value")))
    ends = ranked.groupBy("column", "q").agg(
        holds(F.floor("_at")).alias("_low"), holds(F.ceil("_at")).alias("_high"), F.first("_at").alias("_at")
    )
    between = F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_at") - F.floor("_at"))
    missed = F.raise_error(F.concat(F.lit("a rank lies outside its bracket: "), F.col("column")))
    ends = ends.withColumn("_value", F.coalesce(between, missed.cast("double")))
    wide = ends.groupBy("column").agg(
        *[F.max(F.when(F.col("q") == q, F.col("_value"))).alias(name) for q, name in enumerate(probs)]
    )
    summary = df.sparkSession.range(1).select(first.scalar().alias("_first")).select(F.inline("_first.stats"))
    return summary.drop("around").join(wide, "column", "left")
