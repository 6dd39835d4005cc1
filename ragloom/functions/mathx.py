"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pct2(a, b) -> Column:
    """``round(100 * a / b, 2)`` half-up, computed exactly from integer counts; 0 when b is 0."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return (F.when(b > 0, F.floor((F.lit(20000) * a + b) / (F.lit(2.0) * b)) / F.lit(100.0))
            .otherwise(F.lit(0.0)))


def rnd(c, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits)
