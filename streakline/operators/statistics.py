"""Correlation, regression and tests of streak against orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streakline.functions.association import safe_corr
from streakline.functions.nulls import ratio
from streakline.functions.tails import chi_square_tail, f_tail, t_tail


def corr_streak_orders(master: DataFrame) -> DataFrame:
    """Correlation of the highest streak with campaign-period orders and demand."""
    streak = F.col("max_streak")
    return master.agg(
        safe_corr(streak, F.col("n_orders_during")).alias("cor_orders"),
        safe_corr(streak, F.col("total_demand_during")).alias("cor_demand"),
    )


def ols(df: DataFrame, y: str, x: str) -> DataFrame:
    """Least squares of ``y`` on ``x``: coefficients, their errors, t, R2 and F.

    One pass of regression aggregates. With one regressor F is the square of
    the slope's t. A constant ``x`` has no slope and gives NULLs.
    """
    cy, cx = F.col(y).cast("double"), F.col(x).cast("double")
    sums = df.agg(
        F.regr_count(cy, cx).alias("n"),
        F.regr_avgx(cy, cx).alias("mean_x"),
        F.regr_avgy(cy, cx).alias("mean_y"),
        F.regr_sxx(cy, cx).alias("sxx"),
        F.regr_syy(cy, cx).alias("syy"),
        F.regr_sxy(cy, cx).alias("sxy"),
    )
    n = F.col("n")
    fit = sums.withColumn("slope", ratio(F.col("sxy"), F.col("sxx"))).withColumns(
        {
            "intercept": F.col("mean_y") - F.col("slope") * F.col("mean_x"),
            "rss": F.col("syy") - F.col("slope") * F.col("sxy"),
        }
    )
    variance = ratio(F.col("rss"), n - 2)
    tested = fit.withColumns(
        {
            "slope_se": F.sqrt(ratio(variance, F.col("sxx"))),
            "intercept_se": F.sqrt(
                variance * (ratio(F.lit(1), n) + ratio(F.col("mean_x") ** 2, F.col("sxx")))
            ),
            "r2": F.lit(1.0) - ratio(F.col("rss"), F.col("syy")),
        }
    )
    slope_t = ratio(F.col("slope"), F.col("slope_se"))
    return tested.select(
        "n",
        "intercept",
        "intercept_se",
        ratio(F.col("intercept"), F.col("intercept_se")).alias("intercept_t"),
        "slope",
        "slope_se",
        slope_t.alias("slope_t"),
        "r2",
        (F.lit(1.0) - (F.lit(1.0) - F.col("r2")) * ratio(n - 1, n - 2)).alias("adj_r2"),
        (slope_t * slope_t).alias("f_statistic"),
    )


def ols_p_values(df: DataFrame, y: str, x: str) -> DataFrame:
    """Coefficient table of the same regression with two-sided p-values."""
    fit = ols(df, y, x)

    def row(term: str, of: str) -> Column:
        t = F.col(f"{of}_t")
        return F.struct(
            F.lit(term).alias("term"),
            F.col(of).alias("estimate"),
            F.col(f"{of}_se").alias("std_error"),
            t.alias("t_value"),
            t_tail(t, F.col("n") - 2).alias("p_value"),
        )

    return fit.select(F.inline(F.array(row(x, "slope"), row("(Intercept)", "intercept"))))


def anova(df: DataFrame, group: str, y: str) -> DataFrame:
    """One-way analysis of variance of ``y`` over the levels of ``group``."""
    cy = F.col(y).cast("double")
    levels = (
        df.filter(F.col(group).isNotNull() & cy.isNotNull())
        .groupBy(group)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(cy).alias("mean"),
            (F.var_pop(cy) * F.count(F.lit(1))).alias("ss"),
        )
    )
    n, m = F.col("n"), F.col("mean")
    # one row a level: distances from the grand mean, not a difference of large squares
    every = Window.partitionBy()
    distance = m - ratio(F.sum(n * m).over(every), F.sum(n).over(every))
    total = levels.withColumn("between", n * distance * distance).agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
        F.sum("ss").alias("ss_within"),
        F.sum("between").alias("ss_between"),
    )
    df_between, df_within = F.col("k") - 1, F.col("n") - F.col("k")
    f = ratio(ratio(F.col("ss_between"), df_between), ratio(F.col("ss_within"), df_within))
    return total.select(
        df_between.alias("df_between"),
        df_within.alias("df_within"),
        "ss_between",
        "ss_within",
        f.alias("f_statistic"),
    ).withColumn("p_value", f_tail(F.col("f_statistic"), F.col("df_between"), F.col("df_within")))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson chi-square test of independence of two categorical columns.

    Uses chi2 = N * (sum of o^2 / (row * column) - 1), in which empty cells
    drop out, so only cells that occur are needed.
    """
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(
        F.count(F.lit(1)).cast("double").alias("o")
    )
    margins = cells.withColumns(
        {
            "row_total": F.sum("o").over(Window.partitionBy(a)),
            "column_total": F.sum("o").over(Window.partitionBy(b)),
        }
    )
    part = ratio(F.col("o") * F.col("o"), F.col("row_total") * F.col("column_total"))
    return margins.agg(
        F.sum("o").cast("bigint").alias("n"),
        ((F.countDistinct(a) - 1) * (F.countDistinct(b) - 1)).alias("dof"),
        (F.sum("o") * (F.sum(part) - 1)).alias("chi_square"),
    ).withColumn("p_value", chi_square_tail(F.greatest("chi_square", F.lit(0.0)), F.col("dof")))
