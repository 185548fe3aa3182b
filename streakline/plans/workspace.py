"""The tables that one run of reports keeps in a shared folder while it lasts.

A table is written once and then read by all reports. What is finished is in a manifest,
a row a table, written after the table itself: a run that failed goes on from there under
the same name. ``close`` takes everything away again.
"""

from __future__ import annotations

import tempfile
from datetime import date
from urllib.parse import urlparse
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from streakline.spec import ID

MANIFEST = "name STRING, columns STRING, n_buckets INT"
DAY = "export_day"


def shared_root(spark: SparkSession, folder: str | None = None) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset ``folder``, which on a
    cluster must not be a local one, and in a local session a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return (folder or tempfile.mkdtemp(prefix="streakline-")).rstrip("/")
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS")
    if not folder or (urlparse(folder).scheme or urlparse(default).scheme) == "file":
        raise ValueError("set spark.checkpoint.dir, or give a folder, that all executors share")
    return folder.rstrip("/")


def ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


class Workspace:
    def __init__(self, spark: SparkSession, root: str, run: str | None = None):
        self.spark = spark
        self.database = f"streakline_{run or uuid4().hex}"
        self.folder = f"{root}/{self.database}"
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database} LOCATION '{self.folder}'")
        spark.createDataFrame([], MANIFEST).write.mode("ignore").parquet(f"{self.folder}/manifest")
        rows = spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest").collect()
        self.done = {r["name"]: r for r in rows}

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def record(self, name: str, columns: str = "", n_buckets: int = 0) -> None:
        """Note that ``name`` is finished."""
        row = self.spark.createDataFrame([(name, columns, n_buckets)], MANIFEST)
        row.coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        self.done[name] = row.first()

    def by_day(self, name: str, df: DataFrame, ts: str) -> DataFrame:
        """``df``, written once with a directory a day of ``ts``.

        Days are balanced by size, so neither a day with most of the rows nor many small
        ones decide how long a task takes.
        """
        if name not in self.done:
            dated = df.withColumn(DAY, F.to_date(ts)).hint("rebalance", DAY)
            dated.write.mode("overwrite").partitionBy(DAY).parquet(self.path(name))
            self.record(name, ddl(df.schema))
        return self._dated(name).drop(DAY)

    def days(self, name: str, start: date, end: date) -> DataFrame:
        """The rows of some days of such a table; other directories are not read."""
        return self._dated(name).filter(F.col(DAY).between(start, end)).drop(DAY)

    def _dated(self, name: str) -> DataFrame:
        columns = f"{self.done[name]['columns']}, {DAY} date"
        return self.spark.read.schema(columns).parquet(self.path(name))

    def once(self, name: str, df: DataFrame) -> DataFrame:
        """``df``, written once."""
        if name not in self.done:
            df.write.mode("overwrite").parquet(self.path(name))
            self.record(name, ddl(df.schema))
        return self.plain(name)

    def plain(self, name: str) -> DataFrame:
        """The files of a table without their layout."""
        return self.spark.read.schema(self.done[name]["columns"]).parquet(self.path(name))

    def by_customer(self, name: str, df: DataFrame, n_buckets: int) -> DataFrame:
        """``df``, written once in sorted buckets by customer, so that joins and aggregations
        by customer of such tables need no shuffle."""
        table = f"{self.database}.{name}"
        if name not in self.done:
            known = df.filter(F.col(ID).isNotNull()).repartition(n_buckets, ID)
            writer = known.write.mode("overwrite").format("parquet").option("path", self.path(name))
            writer.bucketBy(n_buckets, ID).sortBy(ID).saveAsTable(table)
            self.record(name, ddl(df.schema), n_buckets)
        elif not self.spark.catalog.tableExists(table):
            row = self.done[name]
            self.spark.sql(
                f"""CREATE TABLE {table} ({row['columns']}) USING parquet
                    CLUSTERED BY ({ID}) SORTED BY ({ID}) INTO {row['n_buckets']} BUCKETS
                    LOCATION '{self.path(name)}'"""
            )
        return self.spark.table(table)

    def close(self) -> None:
        """Drop the tables and delete the folder."""
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.database} CASCADE")
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        self.done = {}
