"""Forecast metrics as aggregate expressions; one pass gives all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: smallest denominator of the fractional error (double precision epsilon).
EPS = 2.220446049250313e-16


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def r2(y: Column, p: Column) -> Column:
    """1 − residual/total; 1 or 0 for a constant y, null below two rows."""
    residual = F.sum((y - p) * (y - p))
    total = F.var_pop(y) * F.count(y)
    return (
        F.when(F.count(y) < 2, F.lit(None))
        .when(total == 0, F.when(residual == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        .otherwise(1 - F.try_divide(residual, total))
    )


def mape_frac(y: Column, p: Column) -> Column:
    """Mean absolute error relative to |y|, as a fraction."""
    return F.avg(F.abs(y - p) / F.greatest(F.abs(y), F.lit(EPS)))


def mape_pct_eps(y: Column, p: Column) -> Column:
    """Mean absolute error relative to y + 1e-8, times 100; huge where y is 0."""
    return F.avg(F.abs(F.try_divide(y - p, y + F.lit(1e-8)))) * 100


def evaluate(
    df: DataFrame, keys: list[str] | None = None, y: str = "y", yhat: str = "yhat",
    include_mape: bool = True,
) -> DataFrame:
    """rmse, mae, r2 and (optional) fractional mape per key."""
    t, p = F.col(y), F.col(yhat)
    cols = [rmse(t, p).alias("rmse"), mae(t, p).alias("mae"), r2(t, p).alias("r2")]
    if include_mape:
        cols.append(mape_frac(t, p).alias("mape"))
    return df.groupBy(*(keys or [])).agg(*cols)


def by_horizon(
    actual: DataFrame, predicted: DataFrame, row_key: list[str], horizon: str = "horizon",
    y: str = "y", yhat: str = "yhat",
) -> DataFrame | None:
    """Metrics per horizon found on both sides; None when a side has no horizon column."""
    if horizon not in actual.columns or horizon not in predicted.columns:
        return None
    pairs = actual.select(horizon, *row_key, y).join(
        predicted.select(horizon, *row_key, yhat), [horizon, *row_key]
    )
    return evaluate(pairs, [horizon], y, yhat)


def horizons(df: DataFrame, horizon: str = "horizon") -> DataFrame:
    return df.select(horizon).distinct()
