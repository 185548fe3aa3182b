"""Tail probabilities against closed forms, for 1 to 10^9 degrees of freedom."""

import math

import pytest
from pyspark.sql import functions as F

from streakline.functions.tails import chi_square_tail, f_tail, t_tail

DFS = (1, 2, 3, 4, 5, 10, 30, 101, 1000, 10**5, 10**7, 10**9)
VALUES = (0.0, 1e-6, 0.01, 0.3, 1.0, 1.96, 3.5, 6.0, 40.0)


def close(found, expected):
    assert found == pytest.approx(expected, abs=2e-8)


def t_two_sided(t, df):
    """Finite sums for whole degrees of freedom; the normal distribution for very many."""
    if df > 10**6:
        return math.erfc(t / math.sqrt(2)) + math.exp(-t * t / 2) * (t**3 + t) / (2 * df * math.sqrt(2 * math.pi))
    angle = math.atan(t / math.sqrt(df))
    c = math.cos(angle) ** 2
    total, term = 0.0, 1.0
    if df % 2 == 0:
        for i in range(df // 2):
            total += term
            term *= c * (2 * i + 1) / (2 * i + 2)
        return 1 - math.sin(angle) * total
    term = math.cos(angle)
    for i in range((df - 1) // 2):
        total += term
        term *= c * (2 * i + 2) / (2 * i + 3)
    return 1 - 2 / math.pi * (angle + math.sin(angle) * total)


def test_t(spark):
    rows = [(t, df) for t in VALUES for df in DFS]
    frame = spark.createDataFrame(rows, "t DOUBLE, df LONG")
    for r in frame.select("t", "df", t_tail(F.col("t"), F.col("df")).alias("p"), t_tail(-F.col("t"), F.col("df")).alias("q")).collect():
        close(r.p, t_two_sided(r.t, r.df))
        assert r.p == r.q


def test_f_with_two_or_equal_degrees(spark):
    rows = [(f, df) for f in VALUES for df in DFS]
    frame = spark.createDataFrame(rows, "f DOUBLE, df LONG")
    p = f_tail(F.col("f"), F.lit(2), F.col("df"))
    swapped = f_tail(F.try_divide(F.lit(1.0), F.col("f")), F.col("df"), F.lit(2))
    for r in frame.select("f", "df", p.alias("p"), swapped.alias("s")).collect():
        expected = math.exp(-r.df / 2 * math.log1p(2 * r.f / r.df))
        close(r.p, expected)
        if r.f:
            close(r.s, 1 - expected)
    even = spark.range(1, 2).select(*[f_tail(F.lit(1.0), F.lit(d), F.lit(d)).alias(str(d)) for d in DFS]).first()
    assert all(v == pytest.approx(0.5, abs=2e-8) for v in even)


def test_chi_square(spark):
    rows = [(x, df) for x in VALUES for df in (1, 2, 4, 6)]
    frame = spark.createDataFrame(rows, "x DOUBLE, df LONG")
    for r in frame.select("x", "df", chi_square_tail(F.col("x"), F.col("df")).alias("p")).collect():
        if r.df == 1:
            expected = math.erfc(math.sqrt(r.x / 2))
        else:
            expected = math.exp(-r.x / 2) * sum((r.x / 2) ** i / math.factorial(i) for i in range(r.df // 2))
        close(r.p, expected)
    # very many degrees of freedom: normal, with the first term of its expansion
    for df in (10**7, 10**9):
        for z in (-2.0, 0.0, 1.0):
            x = df + z * math.sqrt(2 * df)
            p = spark.range(1).select(chi_square_tail(F.lit(x), F.lit(df))).first()[0]
            density = math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
            expected = 0.5 * math.erfc(z / math.sqrt(2)) + math.sqrt(2 / df) / 3 * (z * z - 1) * density
            assert p == pytest.approx(expected, abs=2e-7)


def test_what_has_no_tail_is_null(spark):
    null = F.lit(None).cast("double")
    row = spark.range(1).select(
        t_tail(null, F.lit(5)), t_tail(F.lit(1.0), F.lit(0)), f_tail(F.lit(1.0), F.lit(0), F.lit(5)),
        f_tail(F.lit(-1.0), F.lit(1), F.lit(5)), chi_square_tail(F.lit(1.0), F.lit(0)), chi_square_tail(null, F.lit(2)),
    ).first()
    assert all(v is None for v in row)
