"""Correlation and simple regression as aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_corr(x: Column, y: Column) -> Column:
    """Aggregate: Pearson correlation of complete pairs; NULL when a side is constant."""
    pair = x.isNotNull() & y.isNotNull()
    px, py = F.when(pair, x.cast("double")), F.when(pair, y.cast("double"))
    return F.try_divide(F.covar_pop(px, py), F.stddev_pop(px) * F.stddev_pop(py))
