"""Exact percentiles against numpy, whatever the bucket limits are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from streakline.functions import quantiles
from streakline.functions.quantiles import column_percentiles, exact_percentiles

PROBS = {"p0": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "p99": 0.99, "p100": 1.0}


def check(spark, groups, buckets):
    data = [(g, float(v)) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(data, "g STRING, v DOUBLE").repartition(5)
    got = {r["g"]: r for r in exact_percentiles(df, ["g"], F.col("v"), PROBS, buckets).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        for name, p in PROBS.items():
            assert got[g][name] == pytest.approx(np.percentile(values, p * 100)), (g, name)


@pytest.mark.parametrize("buckets", [2, 7, 128])
def test_matches_linear_interpolation(spark, buckets):
    rng = np.random.default_rng(3)
    groups = {
        "one": [4.0],
        "two": [1.0, 10.0],
        "even": [1, 2, 3, 10],
        "ties": [5.0] * 40 + [1.0, 9.0],
        "normal": rng.normal(size=301).round(3),
        "skewed": np.concatenate([np.full(500, 7.25), rng.lognormal(3, 2, 250).round(2)]),
        "negative": -rng.integers(0, 1000, 100),
    }
    check(spark, groups, buckets)


def test_one_value_in_a_third_of_the_rows(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([np.zeros(1000), rng.uniform(-50, 50, 2000).round(4)])
    check(spark, {"all": values}, 16)


def test_without_keys_and_with_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (2.0,), (4.0,)], "v DOUBLE")
    assert exact_percentiles(df, [], F.col("v"), {"m": 0.5}).first()["m"] == 2.0


def test_null_keys_are_a_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 9.0)], "g STRING, v DOUBLE")
    got = {r["g"]: r["m"] for r in exact_percentiles(df, ["g"], F.col("v"), {"m": 0.5}).collect()}
    assert got == {None: 2.0, "a": 9.0}


def test_only_nulls_give_no_row(spark):
    df = spark.createDataFrame([("a", None)], "g STRING, v DOUBLE")
    assert exact_percentiles(df, ["g"], F.col("v"), {"m": 0.5}).count() == 0


def column_values():
    rng = np.random.default_rng(8)
    n = 50_000
    return {
        "uniform": rng.uniform(-5, 5, n).round(6),
        "skewed": rng.lognormal(2, 3, n).round(4),
        "ties": rng.integers(0, 4, n).astype(float),
        "one value": np.where(rng.random(n) < 0.6, 7.5, rng.normal(7.5, 1, n).round(5)),
        "rising": np.arange(n, dtype=float),
        "some null": np.where(rng.random(n) < 0.4, np.nan, rng.normal(0, 1e6, n).round(3)),
        "few": np.where(np.arange(n) % 5000 == 0, np.arange(n) * 0.5, np.nan),
        "none": np.full(n, np.nan),
    }


@pytest.mark.parametrize("whole", [quantiles.WHOLE, 0])
def test_columns_in_two_passes(spark, monkeypatch, whole):
    """``whole`` 0 takes the bounds from the sketch also where a column has few values."""
    monkeypatch.setattr(quantiles, "WHOLE", whole)
    values = column_values()
    if not whole:
        values = {k: v for k, v in values.items() if k not in ("few", "none")}
    rows = [tuple(None if x != x else float(x) for x in row) for row in zip(*values.values(), strict=True)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` DOUBLE" for c in values)).repartition(7)
    found = {r["column"]: r for r in column_percentiles(df, list(values), PROBS).collect()}
    assert set(found) == set(values)
    for name, own in values.items():
        given = own[~np.isnan(own)]
        r = found[name]
        assert (r["n"], r["n_null"]) == (len(given), len(own) - len(given))
        if len(given):
            assert (r["minimum"], r["maximum"]) == (given.min(), given.max())
            assert r["mean"] == pytest.approx(given.mean())
        for p, share in PROBS.items():
            expected = np.percentile(given, share * 100) if len(given) else None
            assert r[p] == (pytest.approx(expected, rel=1e-12, abs=1e-12) if len(given) else None), (name, p)


def test_columns_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a DOUBLE, b INT")
    rows = column_percentiles(df, ["a", "b"], {"m": 0.5}).collect()
    assert [tuple(r) for r in sorted(rows)] == [("a", 0, 0, None, None, None, None), ("b", 0, 0, None, None, None, None)]
