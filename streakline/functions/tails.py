"""Tail probabilities of the F, t and chi-square distributions, as lazy expressions.

Both are ratios of integrals of one peak whose width is known: of powers of cosine and sine
(the incomplete beta function) and of a power times exp(-y^2) (the incomplete gamma
function). Simpson's rule over twelve widths around the peak, relative to its height, gives
eight decimals for 1 to 10^9 degrees of freedom.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PANELS = 1000
WIDTHS = 12.0
_HALF_PI = 1.5707963267948966
#: The logarithm of a height of nothing.
_NOTHING = -1e9


def _integral(low: Column, high: Column, height: Callable[[Column], Column]) -> Column:
    """Simpson's rule; 0 where ``low`` is not below ``high``."""
    step = (high - low) / PANELS

    def add(total: Column, k: Column) -> Column:
        weight = F.when(k.isin(0, PANELS), 1.0).when(k % 2 == 1, 4.0).otherwise(2.0)
        return total + weight * height(low + step * k)

    total = F.aggregate(F.sequence(F.lit(0), F.lit(PANELS)), F.lit(0.0), add)
    return F.when(low < high, total * step / 3).otherwise(0.0)


def _upper_share(start: Column, peak: Column, width: Column, most: Column | None, height) -> Column:
    """The share of the integral from 0 to ``most`` that lies above ``start``."""
    low = F.greatest(F.lit(0.0), peak - WIDTHS * width)
    high = peak + WIDTHS * width
    high = high if most is None else F.least(most, high)
    share = _integral(F.greatest(low, start), high, height) / _integral(low, high, height)
    return F.when(start.isNotNull(), F.least(share, F.lit(1.0)))


def _power(exponent: Column, moved: Column, base: Column) -> Column:
    """The logarithm of the square root of 1 + moved / base to the power ``exponent``."""
    x = F.try_divide(moved, base)
    return F.when(exponent > 0, F.when(x > -1, exponent / 2 * F.log1p(x)).otherwise(_NOTHING)).otherwise(0.0)


def f_tail(f: Column, between: Column, within: Column) -> Column:
    """The probability of a larger F with ``between`` and ``within`` degrees of freedom."""
    between, within = between.cast("double"), within.cast("double")
    sines, cosines = between - 1, within - 1
    peak = F.atan2(F.sqrt(sines), F.sqrt(cosines))
    peak = F.when(sines + cosines > 0, peak).otherwise(0.0)
    width = F.coalesce(F.try_divide(F.lit(1.0), F.sqrt(2 * (sines + cosines))), F.lit(_HALF_PI))

    def height(angle: Column) -> Column:
        # sin^2 and cos^2 relative to the peak, without the loss of a difference
        moved = F.sin(angle - peak) * F.sin(angle + peak)
        return F.exp(_power(sines, moved, F.sin(peak) ** 2) + _power(cosines, -moved, F.cos(peak) ** 2))

    start = F.atan(F.sqrt(between * f / within))
    valid = (between >= 1) & (within >= 1) & (f >= 0)
    return F.when(valid, _upper_share(start, peak, width, F.lit(_HALF_PI), height))


def t_tail(t: Column, df: Column) -> Column:
    """The probability of a t farther from 0, on either side."""
    return f_tail(t * t, F.lit(1), df)


def chi_square_tail(x: Column, df: Column) -> Column:
    """The probability of a larger chi-square."""
    power = df.cast("double") - 1
    peak = F.sqrt(power / 2)

    def height(y: Column) -> Column:
        away = F.try_divide(y - peak, peak)
        relative = power * (F.log1p(away) - away - away * away / 2)
        return F.exp(F.when(power == 0, -y * y).when(away > -1, relative).otherwise(_NOTHING))

    valid = (power >= 0) & (x >= 0)
    return F.when(valid, _upper_share(F.sqrt(x / 2), peak, F.lit(0.75), None, height))
