"""Request tables: rows within the allowed ranges are accepted, the rest get a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.operators.clean import DATE_COLUMNS, NUMERIC_COLUMNS
from tallyloom.operators.forecast import METHODS

# Allowed ranges of a request.
ASK_RANGES = {"num_retrieval": (1, 20), "max_tokens": (50, 2000), "temperature": (0.0, 1.0)}
ASK_DEFAULTS = {"num_retrieval": 5, "max_tokens": 256, "temperature": 0.7}
FORECAST_RANGES = {"periods": (1, 365)}
FORECAST_DEFAULTS = {"periods": 7, "freq": "D", "date_col": "order_date", "value_col": "quantity"}
FREQUENCIES = ["D", "W", "M"]


def _out_of(name: str, low, high) -> Column:
    c = F.col(name)
    return F.when(c.isNull() | (c < low) | (c > high), F.lit(name))


def _with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    return df.withColumns({
        n: F.coalesce(F.col(n), F.lit(v)) if n in df.columns else F.lit(v)
        for n, v in defaults.items()
    })


def split_ask(df: DataFrame) -> DataFrame:
    """Add ``rejected``: names of the fields out of range, empty text if accepted."""
    d = _with_defaults(df, ASK_DEFAULTS)
    checks = [F.when(F.coalesce(F.length("query"), F.lit(0)) < 1, F.lit("query"))]
    checks += [_out_of(n, lo, hi) for n, (lo, hi) in ASK_RANGES.items()]
    return d.withColumn("rejected", F.concat_ws(",", *checks))


def split_forecast(df: DataFrame) -> DataFrame:
    """Add ``rejected`` as ``split_ask`` does. ``methods`` is an array of method names, null or
    empty for all; dates and values are columns of the order table."""
    d = _with_defaults(df, FORECAST_DEFAULTS)
    if "methods" not in d.columns:
        d = d.withColumn("methods", F.lit(None).cast("array<string>"))
    checks = [_out_of(n, lo, hi) for n, (lo, hi) in FORECAST_RANGES.items()]
    checks.append(F.when(~F.col("freq").isin(FREQUENCIES), F.lit("freq")))
    known = F.array(*[F.lit(m) for m in METHODS])
    unknown = F.exists(F.coalesce("methods", known), lambda m: m.isNull() | ~m.isin(*METHODS))
    checks.append(F.when(unknown, F.lit("methods")))
    checks.append(F.when(~F.col("date_col").isin(DATE_COLUMNS), F.lit("date_col")))
    checks.append(F.when(~F.col("value_col").isin(NUMERIC_COLUMNS), F.lit("value_col")))
    return d.withColumn("rejected", F.concat_ws(",", *checks))


def accepted(df: DataFrame) -> DataFrame:
    return df.filter(F.col("rejected") == "").drop("rejected")
