"""Null-safe arithmetic, so that reports never fail on an empty denominator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` as double; NULL when ``den`` is zero or either side is NULL."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def pct(num: Column, den: Column) -> Column:
    """``num`` as a percentage of ``den``."""
    return ratio(num, den) * 100


def share(condition: Column) -> Column:
    """Aggregate: fraction of rows, with a known condition, where it holds."""
    return ratio(F.count_if(condition), F.count(condition))


def sum0(col: Column) -> Column:
    """Aggregate: sum that is 0 over nothing."""
    total = F.sum(col)
    return F.coalesce(total, F.lit(0))


def mean(col: Column) -> Column:
    """Aggregate: mean of an integer column, exact up to the last division."""
    return ratio(F.sum(col), F.count(col))


def mean_of_ratios(col: Column) -> Column:
    """Aggregate: mean of a double column, independent of the order rows arrive in.

    Doubles added in task order give results that differ from run to run; six
    decimals summed as DECIMAL do not.
    """
    return mean(col.cast("decimal(28,6)"))


#: Sums of money are exact to one of this many parts of a unit.
MONEY_PARTS = 1_000_000


def money_parts(col: Column) -> Column:
    """An amount as whole millionths, so that adding it up is exact and cheap."""
    return F.rint(col * MONEY_PARTS).cast("bigint")


def money(parts: Column) -> Column:
    """Aggregate: whole millionths, added up to an amount; NULL over nothing.

    High and low halves are summed apart, so the sum is exact and cannot overflow before
    it has two billion rows, however large the amounts, and stays a sum of plain numbers.
    """
    high = F.sum(F.shiftright(parts, 32))
    low = F.sum(parts.bitwiseAND(F.lit(0xFFFFFFFF)))
    whole, rest = divmod(2**32, MONEY_PARTS)
    # past the whole numbers that a double holds, units and the fraction are added up last
    left = high * rest + low
    fraction = F.pmod(left, F.lit(MONEY_PARTS))
    units = high * whole + F.call_function("div", left - fraction, F.lit(MONEY_PARTS))
    exact = (high * 2**32 + low) / F.lit(float(MONEY_PARTS))
    return F.when(F.abs(high) < 2**20, exact).otherwise(units + fraction / F.lit(float(MONEY_PARTS)))


def sum_money(col: Column) -> Column:
    """Aggregate: exact sum of an amount; 0 over nothing."""
    return F.coalesce(money(money_parts(col)), F.lit(0.0))


def mean_money(col: Column) -> Column:
    """Aggregate: mean of an amount, exact up to the last division."""
    return ratio(sum_money(col), F.count(col))


def flag(col: Column) -> Column:
    """A boolean with NULL read as false."""
    return F.coalesce(col, F.lit(False))


def text_or_null(col: Column, missing: str = "null") -> Column:
    """Text with the missing-value marker turned into NULL."""
    return F.nullif(col, F.lit(missing))
