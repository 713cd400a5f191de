"""Baseline forecasts for any number of series in one plan.

Every method is an aggregate over the observed points of a series (see
``series.series_points``): the unobserved grid points are zero, so the moving average, the
exponentially weighted mean and the least-squares line need no filled grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.functions.calendar import shift
from tallyloom.functions.numeric import safe_ratio
from tallyloom.operators import metrics, series

# Method names as asked for → as reported.
METHODS = {"sma": "sma", "es": "exponential_smoothing", "trend": "trend"}
ENSEMBLE = "ensemble"

DEFAULT_WINDOW = 7
DEFAULT_ALPHA = 0.3


def check_methods(methods: list[str] | None) -> list[str]:
    if methods is None:
        return list(METHODS)
    unknown = sorted(set(methods) - set(METHODS))
    if unknown:
        raise ValueError(f"unknown forecast methods {unknown}; valid: {', '.join(METHODS)}")
    return [m for m in METHODS if m in methods]


def levels(
    points: DataFrame,
    series_key: list[str],
    window_size: int = DEFAULT_WINDOW,
    alpha: float = DEFAULT_ALPHA,
    n: str = "n",
) -> DataFrame:
    """One row per series: ``n``, ``sma``, ``es`` and the line through the grid.

    Needs ``(series_key…, y, idx, n)`` and, when present, keeps ``stop``. Points at or after
    position ``n`` are not used. The line is kept as mean and slope around the middle.
    """
    a = series.effective_alpha(alpha)
    idx, y, size = F.col("idx"), F.col("y"), F.col(n)
    used = idx < size

    def total(x: Column) -> Column:
        return F.coalesce(F.sum(F.when(used, x)), F.lit(0.0))

    first_weight = F.when(idx == 0, F.lit(1.0)).otherwise(F.lit(a))
    keep = [F.first("stop").alias("stop")] if "stop" in points.columns else []
    sums = points.filter(size > 0).groupBy(*series_key).agg(
        F.first(size).alias("n"),
        *keep,
        total(F.when(idx >= size - window_size, y).otherwise(0.0)).alias("_tail"),
        total(y * first_weight * F.pow(F.lit(1.0 - a), size - 1 - idx)).alias("es"),
        total(y).alias("_sum"),
        total(y * (idx - (size - 1) / 2.0)).alias("_sxy"),
    ).filter(F.col("n") > 0)  # no points at all: no series, also when there is no key
    m = F.col("n").cast("double")
    return sums.select(
        *series_key, "n", *(["stop"] if keep else []),
        (F.col("_tail") / F.least(m, F.lit(float(window_size)))).alias("sma"),
        "es",
        (F.col("_sum") / m).alias("mean"),
        safe_ratio(F.col("_sxy"), m * (m * m - 1) / 12.0).alias("slope"),
    )


def trend_at(position: Column) -> Column:
    """Value of the fitted line at a grid position, not below 0."""
    line = F.col("mean") + F.col("slope") * (position - (F.col("n") - 1) / 2.0)
    return F.greatest(line, F.lit(0.0))


def _method_values(methods: list[str], position: Column) -> list[tuple[str, Column]]:
    by_name = {"sma": F.col("sma"), "es": F.col("es"), "trend": trend_at(position)}
    values = [(METHODS[m], by_name[m]) for m in methods]
    if len(values) > 1:
        mean = sum((v for _, v in values[1:]), values[0][1]) / float(len(values))
        values.append((ENSEMBLE, mean))
    return values


def _explode_methods(values: list[tuple[str, Column]]) -> Column:
    return F.inline(F.array(*[
        F.struct(F.lit(name).alias("method"), v.alias("yhat")) for name, v in values
    ]))


def forecast_points(
    points: DataFrame,
    series_key: list[str],
    periods: int,
    freq: str = "D",
    mode: str = "asfreq",
    methods: list[str] | None = None,
    window_size: int = DEFAULT_WINDOW,
    alpha: float = DEFAULT_ALPHA,
) -> DataFrame:
    """Daily points → ``(series_key…, method, step, t, yhat)``."""
    chosen = check_methods(methods)
    if periods < 1:
        raise ValueError("periods must be at least 1")
    p = series.series_points(points, series_key, freq, mode)
    lv = levels(p, series_key, window_size, alpha)
    steps = lv.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    position = F.col("n") - 1 + F.col("step")
    return steps.select(
        *series_key, "step",
        shift(F.col("stop"), F.col("step"), freq).alias("t"),
        _explode_methods(_method_values(chosen, position)),
    ).select(*series_key, "method", "step", "t", "yhat")


def predict(
    df: DataFrame,
    periods: int = 7,
    date_col: str = "order_date",
    value_col: str = "quantity",
    freq: str = "D",
    methods: list[str] | None = None,
    series_key: list[str] | None = None,
    window_size: int = DEFAULT_WINDOW,
    alpha: float = DEFAULT_ALPHA,
    mode: str = "asfreq",
) -> DataFrame:
    """Forecast each series of an order table; ensemble is the mean when >1 method is asked."""
    key = series_key or []
    points = series.daily(df, key, date_col, value_col)
    return forecast_points(points, key, periods, freq, mode, methods, window_size, alpha)


def by_category(df, periods=7, category_col="category", **kw) -> DataFrame:
    """One forecast per category, each on its own first-to-last day grid."""
    return predict(df, periods, series_key=[category_col], **kw)


def of_revenue(df, periods=7, date_col="order_date", series_key=None,
               null_discount_as_zero=False, **kw) -> DataFrame:
    return predict(
        series.revenue(df, null_discount_as_zero), periods, date_col, "revenue", "D",
        series_key=series_key, **kw,
    )


def of_arrays(df: DataFrame, id_col: str, values_col: str = "historical_data",
              periods: int = 7, methods: list[str] | None = None,
              window_size: int = DEFAULT_WINDOW, alpha: float = DEFAULT_ALPHA) -> DataFrame:
    """Forecast series given inline as arrays; an empty array has no forecast."""
    chosen = check_methods(methods)
    points = df.select(
        id_col, F.size(values_col).alias("n"), F.posexplode(values_col).alias("idx", "y")
    ).withColumn("y", F.coalesce(F.col("y").cast("double"), F.lit(0.0)))
    lv = levels(points, [id_col], window_size, alpha)
    steps = lv.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    values = _method_values(chosen, F.col("n") - 1 + F.col("step"))
    return steps.select(id_col, "step", _explode_methods(values)).select(
        id_col, "method", "step", "yhat"
    )


def split_time(g: DataFrame, fraction: float = 0.8) -> DataFrame:
    """Add ``split``: the first int(n·fraction) grid points are ``train``, the rest ``test``."""
    cut = F.floor(F.col("n") * F.lit(fraction))
    return g.withColumn("cut", cut).withColumn(
        "split", F.when(F.col("idx") < cut, "train").otherwise("test")
    )


def backtest_grid(
    g: DataFrame, series_key: list[str], fraction: float = 0.8,
    window_size: int = DEFAULT_WINDOW, alpha: float = DEFAULT_ALPHA,
) -> DataFrame:
    """Test points with the forecast of every method: ``(series_key…, idx, y, method, yhat)``."""
    parts = split_time(g, fraction)
    slot = series_key or ["_one"]
    if not series_key:
        parts = parts.withColumn("_one", F.lit(1))
    lv = levels(parts, slot, window_size, alpha, n="cut")
    test = parts.filter(F.col("split") == "test").select(*slot, "idx", "y")
    values = _method_values(list(METHODS), F.col("idx"))
    return test.join(lv, slot).select(*series_key, "idx", "y", _explode_methods(values))


def evaluate_grid(g: DataFrame, series_key: list[str], fraction: float = 0.8, **kw) -> DataFrame:
    """Metrics per series and method on the last part of a filled grid."""
    y, p = F.col("y"), F.col("yhat")
    return backtest_grid(g, series_key, fraction, **kw).groupBy(*series_key, "method").agg(
        metrics.mae(y, p).alias("mae"), metrics.rmse(y, p).alias("rmse"),
        metrics.r2(y, p).alias("r2"), metrics.mape_pct_eps(y, p).alias("mape"),
    )


def evaluate(
    df: DataFrame,
    fraction: float = 0.8,
    series_key: list[str] | None = None,
    date_col: str = "order_date",
    value_col: str = "quantity",
    freq: str = "D",
    mode: str = "asfreq",
    **kw,
) -> DataFrame:
    """Metrics per series of an order table and method on the last part of its grid."""
    key = series_key or []
    g = series.prepare_series(df, key, date_col, value_col, freq, mode)
    return evaluate_grid(g, key, fraction, **kw)


def as_arrays(forecast: DataFrame, series_key: list[str] | None = None) -> DataFrame:
    """Long forecast → one array per series and method, in step order."""
    key = series_key or []
    steps = F.array_sort(F.collect_list(F.struct("step", "yhat")))
    return forecast.groupBy(*key, "method").agg(
        F.transform(steps, lambda s: s["yhat"]).alias("values")
    )


def save_baseline(g: DataFrame, path: str, window_size: int = DEFAULT_WINDOW,
                  alpha: float = DEFAULT_ALPHA) -> None:
    """Keep the fitted series and the two parameters; an empty fit is an error."""
    g.write.mode("overwrite").parquet(f"{path}/series")
    spark = g.sparkSession
    if spark.read.parquet(f"{path}/series").isEmpty():
        raise ValueError("nothing was fitted: the series has no rows")
    spark.createDataFrame(
        [(window_size, alpha)], "window_size int, alpha double"
    ).write.mode("overwrite").parquet(f"{path}/params")


def load_baseline(spark: SparkSession, path: str) -> tuple[DataFrame, int, float]:
    """(series, window_size, alpha) of a saved fit."""
    params = spark.read.parquet(f"{path}/params").first()
    return spark.read.parquet(f"{path}/series"), params["window_size"], params["alpha"]
