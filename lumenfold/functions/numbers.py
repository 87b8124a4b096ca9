"""Rounding and small arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

D = Column | str


def col(c: D | float) -> Column:
    return F.col(c) if isinstance(c, str) else F.lit(c) if isinstance(c, (int, float)) else c


def half_up(c: D, digits: int = 0) -> Column:
    """Round halves towards positive infinity: floor(x + 0.5) at the given digit. (round() goes away from zero.)"""
    k = float(10**digits)
    return F.floor(col(c) * k + 0.5) / k


def clamp(c: D, low: float, high: float) -> Column:
    return F.greatest(F.least(col(c), F.lit(high)), F.lit(low))


def cell(c: D, size: float) -> Column:
    """Number of the half-open cell of this size that holds the value."""
    return F.floor(col(c) / size)


def bound(value: Column, then) -> Column:
    """then(value), where value is computed once however often then() names it."""
    return F.element_at(F.transform(F.array(value), then), 1)
