"""Compares catalog queries with their SQL on DuckDB: columns, types and values."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return value


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs, in words; empty when the results are the same."""
    rel = con.sql(sql)
    want_types = dict(zip(rel.columns, map(str, rel.types)))
    got_types = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    out = []
    if set(want_types) != set(got_types):
        return [f"columns: spark-only {set(got_types) - set(want_types)}, sql-only {set(want_types) - set(got_types)}"]
    for c in sorted(want_types):
        if want_types[c] != got_types[c]:
            out.append(f"type of {c}: spark {got_types[c]}, sql {want_types[c]}")
    names = sorted(want_types)
    pick = [rel.columns.index(c) for c in names]
    want = Counter(tuple(_cell(r[i]) for i in pick) for r in rel.fetchall())
    got = Counter(tuple(_cell(r[c]) for c in names) for r in df.collect())
    if want != got:
        extra, missing = list((got - want).elements()), list((want - got).elements())
        out.append(f"rows: {sum(got.values())} vs {sum(want.values())}; columns {names}; "
                   f"spark-only {extra[:3]}; sql-only {missing[:3]}; {len(extra)} differ")
    return out
