"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def rounded(value: Column | str, digits: int = 0) -> Column:
    """Rounding as numpy does it: scale, half to even, scale back."""
    column = _column(value)
    if digits == 0:
        return F.rint(column)
    return F.rint(column * float(10 ** digits)) / float(10 ** digits)


def per(top: Column, bottom: Column) -> Column:
    """Quotient, null where the divisor is zero (ANSI mode would fail)."""
    return top / F.when(bottom != 0, bottom)


def correlation(x: Column | str, y: Column | str) -> Column:
    """Aggregate: Pearson correlation of complete pairs; null where one side is constant."""
    x, y = _column(x), _column(y)
    px, py = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return per(F.covar_pop(px, py), F.stddev_pop(px) * F.stddev_pop(py))
