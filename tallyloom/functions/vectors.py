"""Expressions over ``array<float|double>`` columns; sums run in double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + p)


def l2_norm(a: Column) -> Column:
    return F.sqrt(
        F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )


def normalise(a: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    n = l2_norm(a)
    return F.when(n == 0, a.cast("array<double>")).otherwise(
        F.transform(a, lambda x: x.cast("double") / n)
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity clipped to [-1, 1]; 0 if either side has no length."""
    na, nb = l2_norm(a), l2_norm(b)
    raw = F.try_divide(dot(a, b), na * nb)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))
    )
