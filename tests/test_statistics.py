"""Correlation, regression and tests against textbook formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from streakline.functions.association import safe_corr
from streakline.operators import statistics


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(11)
    x = rng.integers(0, 23, 400)
    y = 2.0 + 0.3 * x + rng.normal(size=400)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(x, y)], "x INT, y DOUBLE")
    return x, y, df.repartition(4)


def test_ols(points):
    x, y, df = points
    got = statistics.ols(df, "y", "x").first()
    n = len(x)
    slope, intercept = np.polyfit(x, y, 1)
    rss = ((y - intercept - slope * x) ** 2).sum()
    sxx = ((x - x.mean()) ** 2).sum()
    r2 = 1 - rss / ((y - y.mean()) ** 2).sum()
    slope_se = np.sqrt(rss / (n - 2) / sxx)
    assert got["n"] == n
    assert got["slope"] == pytest.approx(slope) and got["intercept"] == pytest.approx(intercept)
    assert got["slope_se"] == pytest.approx(slope_se)
    assert got["slope_t"] == pytest.approx(slope / slope_se)
    assert got["intercept_se"] == pytest.approx(
        np.sqrt(rss / (n - 2) * (1 / n + x.mean() ** 2 / sxx))
    )
    assert got["r2"] == pytest.approx(r2)
    assert got["adj_r2"] == pytest.approx(1 - (1 - r2) * (n - 1) / (n - 2))
    assert got["f_statistic"] == pytest.approx((slope / slope_se) ** 2)


def test_p_value_table_agrees_with_ols(points):
    _, _, df = points
    one = statistics.ols(df, "y", "x").first()
    table = {r["term"]: r for r in statistics.ols_p_values(df, "y", "x").collect()}
    assert table["x"]["estimate"] == pytest.approx(one["slope"])
    assert table["x"]["t_value"] == pytest.approx(one["slope_t"])
    assert table["(Intercept)"]["std_error"] == pytest.approx(one["intercept_se"])
    assert table["x"]["p_value"] < 1e-9


def test_constant_regressor_gives_nulls(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 3.0), (1, 5.0)], "x INT, y DOUBLE")
    got = statistics.ols(df, "y", "x").first()
    assert got["n"] == 3 and got["slope"] is None and got["f_statistic"] is None


def test_corr_uses_complete_pairs_only(spark):
    df = spark.createDataFrame(
        [(1, 1.0), (2, 2.0), (3, 5.0), (None, 9.0), (7, None)], "x INT, y DOUBLE"
    )
    got = df.agg(safe_corr(F.col("x"), F.col("y")).alias("r")).first()["r"]
    assert got == pytest.approx(np.corrcoef([1, 2, 3], [1, 2, 5])[0, 1])


def test_corr_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0)], "x INT, y DOUBLE")
    assert df.agg(safe_corr(F.col("x"), F.col("y")).alias("r")).first()["r"] is None


def test_anova(spark):
    groups = {"a": [1.0, 2.0, 4.0], "b": [5.0, 6.0], "c": [0.0, 1.0, 1.0, 2.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g STRING, v DOUBLE")
    got = statistics.anova(df, "g", "v").first()
    every = np.concatenate(list(groups.values()))
    between = sum(len(v) * (np.mean(v) - every.mean()) ** 2 for v in groups.values())
    within = sum(((np.array(v) - np.mean(v)) ** 2).sum() for v in groups.values())
    assert (got["df_between"], got["df_within"]) == (2, 6)
    assert got["ss_between"] == pytest.approx(between) and got["ss_within"] == pytest.approx(within)
    assert got["f_statistic"] == pytest.approx((between / 2) / (within / 6))


def test_chi_square_with_an_empty_cell(spark):
    cells = {("a", "x"): 10, ("a", "y"): 5, ("b", "x"): 7, ("c", "y"): 8}
    df = spark.createDataFrame([k for k, n in cells.items() for _ in range(n)], "p STRING, q STRING")
    got = statistics.chi_square(df, "p", "q").first()
    table = np.array([[10, 5], [7, 0], [0, 8]])
    expected = np.outer(table.sum(1), table.sum(0)) / table.sum()
    assert (got["n"], got["dof"]) == (30, 2)
    assert got["chi_square"] == pytest.approx(((table - expected) ** 2 / expected).sum())
