"""Times the headline queries and prints one JSON line.

Settings come from the environment: ``BENCH_SF_DIR`` (tables), ``BENCH_CPUS``
(cores), ``BENCH_RUNS`` (timed runs after one warm-up; the median counts) and
``BENCH_QUERIES`` (comma-separated names, or ``all``).
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from streakline.plans.catalog import catalog

HEADLINE = (
    "daily_open_rate",
    "funnel_conversion",
    "engagement_summary",
    "order_periods",
    "customer360",
    "streak_distribution",
    "segment_age_gender",
    "segment_orders",
    "reward_selection",
    "basket_by_tier",
    "period_rates_by_group",
    "incremental_impact",
    "pre_post_engagement",
    "ols_streak_orders",
    "cohort_retention",
    "retention_by_segment",
    "hourly_distribution",
    "rebuild_segments",
    "streak_inconsistency",
    "reward_leakage",
    "daily_full",
    "key_overlap",
    "numeric_summary",
    "customer_timeline",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        # call-site capture costs several driver round trips per column expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(spark: SparkSession, query, folder: str) -> float:
    """Seconds to plan and run ``query`` in full; the result rows are dropped."""
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", "")
    queries = catalog()
    chosen = queries if names == "all" else [n for n in names.split(",") if n] or HEADLINE
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    seconds = {}
    for name in chosen:
        timed(spark, queries[name], folder)
        seconds[name] = round(
            statistics.median(timed(spark, queries[name], folder) for _ in range(runs)), 3
        )
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
