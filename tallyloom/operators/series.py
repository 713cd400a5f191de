"""Time series as rows: daily sums, regular grids, fit statistics.

A series is named by ``series_key``, a list of columns; the empty list is one global
series. After ``daily`` a series has at most one row per calendar day, so the windows and
joins below work on groups bounded by the calendar, however many orders a key has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.functions.calendar import (
    check_freq, grid_ceil, grid_floor, shift, steps_between,
)
from tallyloom.operators import ordered

AGGREGATES = {"sum": F.sum, "mean": F.avg, "max": F.max}

GRID_MODES = ("asfreq", "resample")


def aggregate_by_date(
    df: DataFrame,
    series_key: list[str],
    date_col: str = "order_date",
    value_col: str = "quantity",
    func: str = "sum",
) -> DataFrame:
    """One row per series and date: ``(series_key…, t, y)``; func is sum, mean or max."""
    if func not in AGGREGATES:
        raise ValueError(f"unknown aggregate {func!r}; valid: {', '.join(AGGREGATES)}")
    keyed = df.select(*series_key, F.to_date(date_col).alias("t"), F.col(value_col).alias("_v"))
    for c in [*series_key, "t"]:
        keyed = keyed.filter(F.col(c).isNotNull())
    y = AGGREGATES[func](F.col("_v").cast("double"))
    if func == "sum":
        y = F.coalesce(y, F.lit(0.0))
    return keyed.groupBy(*series_key, "t").agg(y.alias("y"))


def daily(df, series_key, date_col="order_date", value_col="quantity") -> DataFrame:
    return aggregate_by_date(df, series_key, date_col, value_col, "sum")


def revenue_of(df: DataFrame, null_discount_as_zero: bool = False) -> Column:
    """quantity · unit_price · (1 − discount) of the rows of ``df``.

    A missing discount makes it null (such rows add 0 to sums) unless asked otherwise.
    """
    discount: Column = F.lit(0.0)
    if "discount" in df.columns:
        discount = F.col("discount").cast("double")
        if null_discount_as_zero:
            discount = F.coalesce(discount, F.lit(0.0))
    return F.col("quantity").cast("double") * F.col("unit_price").cast("double") * (1 - discount)


def revenue(df: DataFrame, null_discount_as_zero: bool = False) -> DataFrame:
    """Add ``revenue``."""
    return df.withColumn("revenue", revenue_of(df, null_discount_as_zero))


def _in_series(series_key: list[str]):
    """Window over one series in time order; a series has at most one row per calendar day."""
    return Window.partitionBy(*(series_key or [F.lit(0)])).orderBy("t")


def series_points(
    points: DataFrame, series_key: list[str], freq: str = "D", mode: str = "asfreq"
) -> DataFrame:
    """Daily points → points on grid dates: ``(series_key…, t, y, idx, n, start, stop)``.

    ``asfreq`` picks the values that fall on grid dates, ``resample`` sums each period. The
    grid itself is not built: what has no row is 0, so sums over the grid are sums over
    these rows. The first grid date always has a row. Series whose grid is empty have none.
    """
    check_freq(freq)
    if mode not in GRID_MODES:
        raise ValueError(f"unknown grid mode {mode!r}; valid: {', '.join(GRID_MODES)}")
    p, last = points, F.col("t")
    if freq != "D":
        end = grid_ceil(F.col("t"), freq)
        picked = F.col("y") if mode == "resample" else F.when(
            end == F.col("t"), F.col("y")).otherwise(F.lit(0.0))
        p = points.groupBy(*series_key, end.alias("_end")).agg(
            F.sum(picked).alias("y"), F.max("t").alias("_last")
        ).withColumnRenamed("_end", "t")
        last = F.col("_last") if mode == "asfreq" else F.col("t")
    whole = _in_series(series_key).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        p.withColumn("start", F.min("t").over(whole))
        .withColumn("stop", grid_floor(F.max(last).over(whole), freq))
        .filter(F.col("t") <= F.col("stop"))
        .select(
            *series_key, "t", "y",
            steps_between(F.col("start"), F.col("t"), freq).alias("idx"),
            (steps_between(F.col("start"), F.col("stop"), freq) + 1).alias("n"),
            "start", "stop",
        )
    )


def grid(
    points: DataFrame, series_key: list[str], freq: str = "D", mode: str = "asfreq"
) -> DataFrame:
    """Complete grid per series: ``(series_key…, t, y, idx, n)``, gaps filled with 0.

    Every point fills the gap up to the next one, so no second pass over the orders is
    needed for the bounds and no join.
    """
    p = series_points(points, series_key, freq, mode)
    following = F.lead("idx").over(_in_series(series_key))
    filled = p.withColumn("_to", F.coalesce(following, F.col("n")) - 1).withColumn(
        "_g", F.explode(F.sequence(F.col("idx"), F.col("_to"))))
    return filled.select(
        *series_key, shift(F.col("start"), F.col("_g"), freq).alias("t"),
        F.when(F.col("_g") == F.col("idx"), F.col("y")).otherwise(F.lit(0.0)).alias("y"),
        F.col("_g").alias("idx"), "n",
    )


def prepare_series(
    df: DataFrame,
    series_key: list[str] | None = None,
    date_col: str = "order_date",
    value_col: str = "quantity",
    freq: str = "D",
    mode: str = "asfreq",
) -> DataFrame:
    """Rows → daily sums → complete grid."""
    key = series_key or []
    return grid(daily(df, key, date_col, value_col), key, freq, mode)


def grid_stats(g: DataFrame, series_key: list[str]) -> DataFrame:
    """Per series: mean, std (sample), min, max, periods and date_range of a filled grid."""
    text = F.concat(
        F.min("t").cast("string"), F.lit(" 00:00:00 to "), F.max("t").cast("string"),
        F.lit(" 00:00:00"),
    )
    return g.groupBy(*series_key).agg(
        F.avg("y").alias("mean"), F.stddev_samp("y").alias("std"),
        F.min("y").alias("min"), F.max("y").alias("max"),
        F.count("*").alias("periods"), text.alias("date_range"),
    ).filter(F.col("periods") > 0)


def fit_stats(
    df: DataFrame,
    series_key: list[str] | None = None,
    date_col: str = "order_date",
    value_col: str = "quantity",
    freq: str = "D",
    mode: str = "asfreq",
) -> DataFrame:
    """Statistics of each series of an order table."""
    key = series_key or []
    return grid_stats(prepare_series(df, key, date_col, value_col, freq, mode), key)


def last_points(g: DataFrame, series_key: list[str], window_size: int) -> DataFrame:
    """The last ``window_size`` grid points of each series."""
    return g.filter(F.col("idx") >= F.col("n") - window_size)


def sma_series(g: DataFrame, series_key: list[str], periods: int) -> DataFrame:
    """Moving average along the grid; null until the window is full."""
    w = Window.partitionBy(*series_key) if series_key else Window.partitionBy(F.lit(0))
    frame = w.orderBy("idx").rowsBetween(-(periods - 1), 0)
    full = F.col("idx") >= periods - 1
    return g.withColumn("sma", F.when(full, F.avg("y").over(frame)))


def effective_alpha(alpha: float) -> float:
    """Weight of the newest point: smoothing runs with span 1/alpha, i.e. 2·alpha/(1+alpha)."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    return 2.0 * alpha / (1.0 + alpha)


def es_series(
    g: DataFrame, series_key: list[str], alpha: float = 0.3, name: str = "es"
) -> DataFrame:
    """Exponentially smoothed series along the grid."""
    return ordered.ewm(g, series_key, "y", {name: effective_alpha(alpha)}, pos_col="idx")


def last_value(g: DataFrame, series_key: list[str], value_col: str) -> DataFrame:
    """Value of each series at its last grid point."""
    return g.groupBy(*series_key).agg(F.max_by(value_col, "idx").alias(value_col))
