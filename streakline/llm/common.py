"""Staged tables and text helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII white space, the separator of words in every contract of this subpackage.
SPACE = r"[\x20\x09-\x0D]"
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, also where lambdas refer to it."""
    return F.get(F.transform(F.array(value), body), 0)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; in a local session without it, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="staged-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_noted: list[list[str]] = []
_kept: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept by a worker process for its next tasks; only the last one
    is, so that the operators that a worker serves do not add up in its memory."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def forget_kept() -> None:
    """Free what another operator has kept."""
    _kept.clear()


@contextmanager
def noting_staged() -> Iterator[list[str]]:
    """The paths of all tables that are staged inside."""
    _noted.append([])
    try:
        yield _noted[-1]
    finally:
        _noted.pop()


def delete_staged(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables that nothing reads any more."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    for noted in _noted:
        noted.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def aliased(keep: list[str]) -> list[Column]:
    """Columns to carry along, under names that clash with nothing an operator adds."""
    return [F.col(f"`{name}`").alias(f"kept_{i}") for i, name in enumerate(keep)]


def restored(keep: list[str]) -> list[Column]:
    """The columns of ``aliased`` under their own names again."""
    return [F.col(f"kept_{i}").alias(name) for i, name in enumerate(keep)]


def aliased_schema(df: DataFrame, keep: list[str]) -> str:
    """DDL of the columns of ``aliased``."""
    return ", ".join(
        f"kept_{i} {df.schema[name].dataType.simpleString()}" for i, name in enumerate(keep)
    )
