"""Times the latest row of each customer: by a struct, which Spark plans as a sort before the
shuffle, against a packed DECIMAL(38, 0) key, which it keeps in a hash table.

``python benches/latest_per_key.py ROWS CUSTOMERS MEMORY FOLDER``; FOLDER gets shuffle files
and the event log, from which the spilled bytes are read.
"""

from __future__ import annotations

import json
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

DAY_0 = 1_704_412_800


def main(rows: int, customers: int, memory: str, folder: str) -> None:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "32")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.local.dir", folder)
        .config("spark.eventLog.enabled", "true")
        .config("spark.eventLog.compress", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.eventLog.dir", f"file://{folder}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    number = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))
    log = spark.range(rows).select(
        number(0, customers).alias("customer"),
        F.timestamp_seconds(DAY_0 + number(1, 22 * 86_400_000) / 1000).cast("timestamp_ntz").alias("timestamp"),
        F.col("id").alias("event_id"),
        number(2, 23).cast("int").alias("streak"),
    )
    # 45 bits of microseconds, 64 of the event id, 17 of the streak
    packed = F.expr(
        f"""cast(unix_micros(cast(timestamp as timestamp)) - {DAY_0}000000 as decimal(15, 0)) * {2**81}BD
            + (cast(event_id as decimal(19, 0)) + {2**63}BD) * {2**17}BD + streak"""
    )
    latest = {
        "max only": F.max("streak"),
        "struct": F.max_by("streak", F.struct("timestamp", "event_id", "streak")),
        "packed": F.max_by("streak", packed),
    }
    for name, value in latest.items():
        start = time.perf_counter()
        found = log.groupBy("customer").agg(
            F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("last"), value.alias("streak")
        )
        digest = found.agg(F.sum(F.hash("customer", "n", "last", "streak").cast("long"))).first()[0]
        print(name, round(time.perf_counter() - start, 1), "s, digest", digest, flush=True)
    spark.stop()
    spilled: dict[int, float] = {}
    for file in Path(folder).rglob("*"):
        if file.is_file() and file.name.startswith("events_"):
            for line in file.open():
                event = json.loads(line)
                if event["Event"] == "SparkListenerTaskEnd":
                    stage = event["Stage ID"]
                    disk = (event.get("Task Metrics") or {}).get("Disk Bytes Spilled", 0)
                    spilled[stage] = spilled.get(stage, 0) + disk / 1e6
    print("MB spilled to disk by stage:", {k: round(v) for k, v in sorted(spilled.items())})


if __name__ == "__main__":
    main(int(sys.argv[1]), int(sys.argv[2]), sys.argv[3], sys.argv[4])
