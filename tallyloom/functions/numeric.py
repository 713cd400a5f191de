"""Scalar number helpers, all JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_even(x: Column, places: int) -> Column:
    """Round by scaling and rounding halves to even, as array libraries do."""
    scale = F.lit(10.0**places)
    return F.rint(x * scale) / scale


def safe_ratio(num: Column, den: Column, fallback: float = 0.0) -> Column:
    """num / den, ``fallback`` where den is zero (never raises under ANSI mode)."""
    return F.when(den == 0, F.lit(fallback)).otherwise(F.try_divide(num, den))


def nullif_nan(x: Column) -> Column:
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)
