"""Whole jobs on order tables, composed from the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tallyloom.operators import clean, features, forecast, forest, requests, series
from tallyloom.session import settle


def forecast_job(orders: DataFrame, periods: int = 7, freq: str = "D",
                 methods: list[str] | None = None, **kw) -> DataFrame:
    """Numeric-only input (negatives stay), then the global forecast."""
    return forecast.predict(clean.numeric_only(orders), periods, freq=freq, methods=methods, **kw)


def _points_by_columns(orders: DataFrame) -> DataFrame:
    """Daily sums ``(date_col, value_col, t, y)`` of every value column by every date column that
    the orders have, in one pass over them."""
    dates = [c for c in clean.DATE_COLUMNS if c in orders.columns]
    values = [c for c in clean.NUMERIC_COLUMNS if c in orders.columns]
    by_date = F.explode(F.array(*[
        F.struct(F.lit(c).alias("date_col"), F.to_date(c).alias("t")) for c in dates]))
    sums = (
        orders.select(by_date.alias("_d"), *[F.col(v).cast("double").alias(v) for v in values])
        .select("_d.*", *values).filter(F.col("t").isNotNull()).groupBy("date_col", "t")
        .agg(*[F.coalesce(F.sum(v), F.lit(0.0)).alias(v) for v in values]))
    return sums.select("date_col", "t", F.inline(F.array(*[
        F.struct(F.lit(v).alias("value_col"), F.col(v).alias("y")) for v in values])))


def forecast_requests_job(orders: DataFrame, asked: DataFrame) -> DataFrame:
    """Forecast per accepted request ``(request_id, periods, freq, methods, date_col, value_col)``,
    defaults for what is missing, on one order table.

    The orders are read once, for daily sums of all columns that may be asked for. The grids are
    forecast for the longest horizon, at most 3 frequencies · 6 column pairs · 365 rows that every
    task may have; requests pick their rows, methods and the mean of these.
    """
    ok = requests.accepted(requests.split_forecast(asked)).select(
        "request_id", "periods", "freq", "methods", "date_col", "value_col")
    top = requests.FORECAST_RANGES["periods"][1]
    points = settle(_points_by_columns(clean.numeric_only(orders)), "daily")
    pair = ["date_col", "value_col"]
    tables = [
        forecast.forecast_points(points, pair, top, f).withColumn("freq", F.lit(f))
        for f in requests.FREQUENCIES
    ]
    names = list(forecast.METHODS.values())
    every = reduce(DataFrame.unionByName, tables).groupBy("freq", *pair, "step", "t").agg(
        *[F.max(F.when(F.col("method") == n, F.col("yhat"))).alias(n) for n in names])
    chosen = F.filter(F.array(*[
        F.struct(F.lit(n).alias("method"), F.col(n).alias("yhat"), F.lit(m).alias("name"))
        for m, n in forecast.METHODS.items()]), lambda v: (
            F.coalesce(F.size("methods"), F.lit(0)) <= 0) | F.array_contains("methods", v["name"]))
    mean = F.aggregate(F.col("_c"), F.lit(0.0), lambda a, v: a + v["yhat"]) / F.size("_c")
    values = F.transform("_c", lambda v: F.struct(v["method"].alias("method"), v["yhat"].alias("yhat")))
    all_rows = F.when(F.size("_c") > 1, F.concat(values, F.array(F.struct(
        F.lit(forecast.ENSEMBLE).alias("method"), mean.alias("yhat"))))).otherwise(values)
    return (
        ok.join(F.broadcast(every), ["freq", *pair]).filter(F.col("step") <= F.col("periods"))
        .withColumn("_c", chosen)
        .select("request_id", "freq", *pair, "step", "t", F.inline(all_rows))
    )


def summary(orders: DataFrame, periods: int = 7) -> DataFrame:
    """Fit statistics, quantity, revenue and category forecasts and metrics in one table:
    ``(section, series, method, item, value)``.

    The orders are read once, for daily sums by category that are written; totals are sums
    of these. The date text of the fit statistics is left to ``series.fit_stats``.
    """
    t = F.to_date("order_date")
    cells = settle(
        orders.withColumn("t", t).filter(F.col("t").isNotNull()).groupBy("category", "t").agg(
            F.coalesce(F.sum(F.col("quantity").cast("double")), F.lit(0.0)).alias("quantity"),
            F.coalesce(F.sum(series.revenue_of(orders)), F.lit(0.0)).alias("revenue"),
        ), "cells",
    )
    total = cells.groupBy("t").agg(F.sum("quantity").alias("y"))
    money = cells.groupBy("t").agg(F.sum("revenue").alias("y"))
    by_category = cells.filter(F.col("category").isNotNull()).select(
        "category", "t", F.col("quantity").alias("y"))
    g = series.grid(total, [])

    def rows(df, section, name, method, item, value):
        return df.select(F.lit(section).alias("section"), name.alias("series"),
                         method.alias("method"), item.cast("string").alias("item"),
                         value.alias("value"))

    def items(names):
        return F.inline(F.array(*[
            F.struct(F.lit(n).alias("item"), F.col(n).cast("double").alias("value"))
            for n in names
        ]))

    none = F.lit("")
    item, value, method = F.col("item"), F.col("value"), F.col("method")
    stats = series.grid_stats(g, []).select(items(["mean", "std", "min", "max", "periods"]))
    tested = forecast.evaluate_grid(g, []).select("method", items(["mae", "rmse", "r2", "mape"]))
    parts = [
        rows(stats, "fit_statistics", none, none, item, value),
        rows(tested, "metrics", none, method, item, value),
    ]
    for section, points, key, name in (
        ("quantity_forecast", total, [], none),
        ("revenue_forecast", money, [], none),
        ("category_forecast", by_category, ["category"], F.col("category")),
    ):
        f = forecast.forecast_points(points, key, periods)
        parts.append(rows(f, section, name, method, F.col("step"), F.col("yhat")))
    return reduce(DataFrame.unionByName, parts)


def training_rows(orders: DataFrame, horizon: int = 7, **families) -> tuple[DataFrame, list[str]]:
    """Order rows with features, the target joined by date, and the split; feature names.

    The target is per date, so it is joined on the order date.
    """
    wide, names = features.all_features(orders, **families)
    future = features.target(orders, forecast_horizon=horizon).select(
        F.col("t").alias("order_date"), "target")
    rows = wide.join(future, "order_date")
    return forest.split_random(forest.valid_rows(rows, names, "target")), names
