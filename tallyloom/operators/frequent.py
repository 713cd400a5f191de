"""The k most frequent items of a column, without a shuffle of all distinct ones.

Every task sums its rows up in a frequent-items summary of bounded size (Misra–Gries counters), the summaries
are merged in steps, and what they cannot tell is bounded: an estimate is never below the true count and at
most ``error`` above it, and an item that is not listed has at most 2 · ``error``. So the items whose estimate
reaches the k-th best less ``error`` hold all of the k most frequent, if that limit is above what an unlisted
item may have; an exact count of these few settles the rest.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tallyloom.session import settle

# Counters of a summary: three quarters of the slots of its table.
ITEMS = 3 << 16
# The summary's error is at most so many times the rows, over the slots.
_ERROR = 3.5


@dataclass(frozen=True)
class Found:
    """``candidates`` is None if the summary cannot tell them, and an exact count of all has to."""

    candidates: DataFrame | None
    rows: int
    error: int
    listed: int
    kept: int


def estimates(values: DataFrame, col: str, items: int = ITEMS) -> tuple[DataFrame, int, int]:
    """((item, estimate), rows, error): at most ``items`` rows, written once; null values do not count."""
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = values.filter(F.col(col).isNotNull()).select(F.col(col).alias("_item"), F.spark_partition_id().alias("_part"))
    states = own.groupBy((F.col("_part") % parts).alias("_part")).agg(
        F.expr(f"approx_top_k_accumulate(_item, {items})").alias("_state"), F.count("*").alias("_n"))
    # a task merges the square root of all summaries at most
    for left in (math.isqrt(parts - 1) + 1, 1):
        states = states.groupBy((F.col("_part") % left).alias("_part")).agg(
            F.expr(f"approx_top_k_combine(_state, {items})").alias("_state"), F.sum("_n").alias("_n"))
    rows = settle(states.select(F.expr(f"approx_top_k_estimate(_state, {items})").alias("_top"), "_n"), "summary")
    n = rows.agg(F.sum("_n")).first()[0] or 0
    slots = 1 << math.ceil(math.log2(items / 0.75))
    listed = rows.select(F.inline("_top")).select("item", F.col("count").alias("estimate"))
    return listed, n, math.floor(_ERROR * n / slots)


def candidates(values: DataFrame, col: str, k: int, items: int = ITEMS) -> Found:
    """Items that hold all of the k most frequent ones, ties included."""
    listed, n, error = estimates(values, col, items)
    if n == 0:
        return Found(listed.select("item"), 0, 0, 0, 0)
    size = listed.count()
    last = listed.orderBy(F.desc("estimate")).limit(k).agg(F.count("*"), F.min("estimate")).first()
    least = last[1] - error if last[0] == k else 0
    if error and least <= 2 * error:
        return Found(None, n, error, size, 0)
    kept = settle(listed.filter(F.col("estimate") >= least).select("item"), "candidates")
    return Found(kept, n, error, size, kept.count())
