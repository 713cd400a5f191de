"""Calendar grids: which dates are grid points, and their running index.

``D`` has every day, ``W`` every Sunday, ``M`` every month end.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

FREQUENCIES = ("D", "W", "M")


def check_freq(freq: str) -> None:
    if freq not in FREQUENCIES:
        raise ValueError(f"unknown frequency {freq!r}; valid: {', '.join(FREQUENCIES)}")


def grid_ceil(day: Column, freq: str) -> Column:
    """First grid point on or after ``day`` (also the end of the period ``day`` lies in)."""
    if freq == "D":
        return day
    if freq == "W":
        return F.next_day(F.date_sub(day, 1), "SU")
    return F.last_day(day)


def grid_floor(day: Column, freq: str) -> Column:
    """Last grid point on or before ``day``."""
    if freq == "D":
        return day
    if freq == "W":
        return F.date_sub(F.next_day(day, "SU"), 7)
    return F.when(F.last_day(day) == day, day).otherwise(
        F.date_sub(F.trunc(day, "month"), 1)
    )


def _month_number(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def steps_between(start: Column, stop: Column, freq: str) -> Column:
    """Number of grid steps from ``start`` to ``stop``, both grid points."""
    if freq == "M":
        return _month_number(stop) - _month_number(start)
    days = F.datediff(stop, start)
    return days if freq == "D" else (days / 7).cast("int")


def shift(point: Column, steps: Column, freq: str) -> Column:
    """Grid point ``steps`` after ``point``."""
    if freq == "M":
        return F.last_day(F.add_months(point, steps))
    return F.date_add(point, (steps * (1 if freq == "D" else 7)).cast("int"))
