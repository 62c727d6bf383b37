"""Scalar numeric helpers shared by several reports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def relative_change(current: Column, previous: Column) -> Column:
    """(current - previous) / previous; null when there is no base to compare with."""
    return F.try_divide(current - previous, previous)


def clamp01(value: Column) -> Column:
    """Limit to [0, 1]; anything that is not a finite number becomes 0."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(finite, F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def clip01(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def finite(value: Column) -> Column:
    """NaN to null, so that sums, means and comparisons skip it."""
    return F.when(~F.isnan(value), value)
