"""Feature families for demand models. Every family adds columns to the order rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tallyloom.operators import ordered, series
from tallyloom.session import settle

LAGS = [1, 7, 14, 30]
WINDOWS = [7, 14, 30]
SPANS = [7, 30]

TEMPORAL = [
    "day_of_week", "day_of_month", "week_of_year", "month", "quarter", "is_weekend",
    "is_month_end", "day_of_year", "sin_month", "cos_month", "sin_day_of_week",
    "cos_day_of_week",
]


def temporal(df: DataFrame, date_col: str = "order_date") -> DataFrame:
    """Calendar features; Monday is 0, ISO weeks run to 53."""
    d = F.to_date(date_col)
    dow, month = F.weekday(d), F.month(d)

    def wave(fn, x: Column, period: int) -> Column:
        return fn(F.lit(2 * math.pi) * x / period)

    cols = [
        dow, F.dayofmonth(d), F.weekofyear(d), month, F.quarter(d),
        (dow >= 5).cast("int"), (F.last_day(d) == d).cast("int"), F.dayofyear(d),
        wave(F.sin, month, 12), wave(F.cos, month, 12),
        wave(F.sin, dow, 7), wave(F.cos, dow, 7),
    ]
    return df.withColumns(dict(zip(TEMPORAL, cols)))


def price(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Price and discount features; a family member needs its columns to exist.

    ``source`` (also of the families below) has the same rows as ``df`` with a shorter plan;
    statistics over all rows are taken from it.
    """
    new = {}
    base = source or df
    if "unit_price" in df.columns:
        p = F.col("unit_price")
        # one row of statistics, read as scalar subqueries
        mean = base.agg(F.avg("unit_price")).scalar()
        std = base.agg(F.stddev_samp("unit_price")).scalar()
        new["unit_price_normalized"] = (p - mean) / (std + F.lit(1e-8))
        new["unit_price_log"] = F.log1p(p)
    if "discount" in df.columns:
        new["has_discount"] = F.coalesce((F.col("discount") > 0).cast("int"), F.lit(0))
        new["discount_rate"] = F.col("discount")
    if {"quantity", "unit_price"} <= set(df.columns):
        new["revenue_per_unit"] = F.col("unit_price") * F.col("quantity")
    return df.withColumns(new)


def interaction(
    df: DataFrame, order_cols: list[str] | None = None, source: DataFrame | None = None
) -> DataFrame:
    """Products of columns, and a code per (category, region) by first appearance."""
    out = df
    if {"quantity", "unit_price"} <= set(df.columns):
        out = out.withColumn("qty_price_interaction", F.col("quantity") * F.col("unit_price"))
    if {"quantity", "discount"} <= set(df.columns):
        out = out.withColumn("qty_discount_interaction", F.col("quantity") * F.col("discount"))
    if {"category", "region"} <= set(df.columns):
        order = order_cols or ["row_id"]

        def text(c):
            return F.coalesce(F.col(c).cast("string"), F.lit("nan"))

        key = F.concat_ws("_", text("category"), text("region"))
        out = out.withColumn("_pair", key)
        first = (source or df).groupBy(key.alias("_pair")).agg(
            F.min(F.struct(*order)).alias("_first"))
        codes = settle(ordered.positions(first, [], ["_first"], unique=True).select(
            "_pair", F.col("_pos").alias("category_region_group")
        ), "codes")
        out = out.join(codes, "_pair").drop("_pair")
    return out


def group_stats(
    df: DataFrame, key: str, aggregates: dict[str, Column]
) -> DataFrame:
    """Spread statistics of a key's rows to the rows.

    Aggregate and join back rather than a window: the aggregate combines on the map side,
    and a key with very many rows is never gathered in one task. The statistics are written,
    so the planner knows their size and leaves the rows where they are if they are few.
    """
    stats = settle(df.filter(F.col(key).isNotNull()).groupBy(key).agg(
        *[c.alias(n) for n, c in aggregates.items()]
    ), "stats")
    return df.join(stats, key, "left")


def aggregations(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Quantity and revenue sums and means by category and region, mean by supplier.

    All keys are aggregated in one pass over the rows by grouping sets.
    """
    keys = [k for k in ("category", "region", "supplier_id") if k in df.columns]
    if not keys:
        return df
    rev = series.revenue_of(df)
    sets = settle(
        (source or df).groupingSets([[k] for k in keys], *keys).agg(
            F.grouping_id().alias("_set"),
            F.sum("quantity").alias("qty_sum"), F.avg("quantity").alias("qty_mean"),
            F.sum(rev).alias("revenue_sum"), F.avg(rev).alias("revenue_mean"),
        ), "sets",
    )
    measures = ("qty_sum", "qty_mean", "revenue_sum", "revenue_mean")
    out = df
    for i, key in enumerate(keys):
        # in the grouping id every key but this one has its bit set
        own = (2 ** len(keys) - 1) ^ 2 ** (len(keys) - 1 - i)
        part = sets.filter((F.col("_set") == own) & F.col(key).isNotNull())
        if key == "supplier_id":
            part = part.select(key, F.col("qty_mean").alias("supplier_avg_qty"))
        else:
            part = part.select(key, *[F.col(m).alias(f"{key}_{m}") for m in measures])
        out = out.join(settle(part, "stats"), key, "left")
    return out


def _for_groups(df, value_col, group_cols, order_cols, build) -> DataFrame:
    """Apply ``build(df, keys, suffix)`` on positioned rows, for every grouping column.

    A null group has no values, as rows without a key belong to no group. The default order ends
    with the row id, which tells rows apart.
    """
    unique, order_cols = not order_cols, _order(order_cols)
    if not group_cols:
        return build(ordered.positions(df, [], order_cols, unique=unique), [], "").drop("_pos")
    if len(group_cols) > 1:
        return _for_all_groups(df, value_col, group_cols, order_cols, unique, build)
    g = group_cols[0]
    grouped = df.filter(F.col(g).isNotNull())
    done = build(ordered.positions(grouped, [g], order_cols, unique=unique), [g], f"_{g}").drop("_pos")
    return done.unionByName(df.filter(F.col(g).isNull()), allowMissingColumns=True)


def _for_all_groups(df, value_col, group_cols, order_cols, unique, build) -> DataFrame:
    """One numbering for several grouping columns.

    Only (row, order, value) goes into the range shuffle, once per grouping column and under its name and
    key; the features come back by row and are joined to the rows, which move once.
    """
    row = "row_id" if unique else "_row"
    if not unique:
        df = settle(df.withColumn(row, F.monotonically_increasing_id()), "rows")
    parts = F.array(*[F.struct(F.lit(g).alias("_col"), F.col(g).cast("string").alias("_key")) for g in group_cols])
    narrow = df.select(*dict.fromkeys([row, *order_cols, value_col]), F.inline(parts)).filter(
        F.col("_key").isNotNull())
    order = order_cols if unique else [*order_cols, row]
    placed = ordered.positions(narrow, ["_col", "_key"], order, unique=True)
    done = build(placed, ["_col", "_key"], "").drop("_pos")
    names = [c for c in done.columns if c not in narrow.columns]
    back = done.groupBy(F.col(row).alias("_of")).agg(*[
        F.max(F.when(F.col("_col") == g, F.col(c))).alias(f"{c}_{g}") for g in group_cols for c in names])
    out = df.join(back, F.col(row) == F.col("_of"), "left").drop("_of")
    return out if unique else out.drop(row)


def _one_per_id(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows of one id have the largest of their values, rows without an id none.

    Only hashes of the ids are shuffled to find those that come more than once; their rows alone are gathered.
    """
    df = df.withColumns({c: F.when(F.col("row_id").isNotNull(), F.col(c)) for c in names})
    own = F.xxhash64("row_id")
    twice = settle(df.filter("row_id IS NOT NULL").groupBy(own.alias("_hash")).count().filter("count > 1").select(
        "_hash"), "twice")
    if twice.isEmpty():
        return df
    some = df.join(twice, own == F.col("_hash"), "left_semi")
    most = some.groupBy(F.col("row_id").alias("_of")).agg(*[F.max(c).alias(c) for c in names])
    some = some.drop(*names).join(most, F.col("row_id") == F.col("_of"), "left").select(*df.columns)
    return df.join(twice, own == F.col("_hash"), "left_anti").unionByName(some)


def _order(order_cols):
    return order_cols or ["order_date", "row_id"]


def lag(df, value_col="quantity", lags=None, group_cols=None, order_cols=None) -> DataFrame:
    """Earlier values by row order; each grouping column gives its own features."""
    if group_cols and len(group_cols) > 1 and not any(isinstance(
            df.schema[g].dataType, (T.ArrayType, T.MapType, T.StructType)) for g in group_cols):
        out = ordered.streamed(df, value_col, _order(order_cols), not order_cols, lags or LAGS, groups=group_cols)[0]
        return out if order_cols else _one_per_id(out, [c for c in out.columns if c not in df.columns])
    return _for_groups(df, value_col, group_cols, order_cols, lambda d, k, s: ordered.lag_roll(
        d, k, value_col, lags or LAGS, [], s))


def rolling(df, value_col="quantity", windows=None, group_cols=None, order_cols=None):
    """Mean, std and max of the last n rows; shorter windows at the start."""
    return _for_groups(df, value_col, group_cols, order_cols, lambda d, k, s: ordered.lag_roll(
        d, k, value_col, [], windows or WINDOWS, s))


def _span_alphas(value_col, spans, suffix):
    return {f"{value_col}_ewma_{n}{suffix}": 2.0 / (n + 1) for n in spans}


def ewma(df, value_col="quantity", spans=None, group_cols=None, order_cols=None) -> DataFrame:
    """Exponentially weighted means with factor 2/(span+1)."""
    return _for_groups(df, value_col, group_cols, order_cols, lambda d, k, s: ordered.ewm(
        d, k, value_col, _span_alphas(value_col, spans or SPANS, s)))


def target(
    df: DataFrame, value_col: str = "quantity", forecast_horizon: int = 7,
    agg_func: str = "sum", series_key: list[str] | None = None,
) -> DataFrame:
    """Per date the aggregate ``forecast_horizon`` existing dates later: ``(…, t, y, target)``."""
    key = series_key or []
    points = series.aggregate_by_date(df, key, "order_date", value_col, agg_func)
    w = Window.partitionBy(*(key or [F.lit(0)])).orderBy("t")
    return points.withColumn("target", F.lead("y", forecast_horizon).over(w))


def fill_zero(df: DataFrame, names: list[str]) -> DataFrame:
    return df.fillna(0, subset=names)


def all_features(
    df: DataFrame,
    temporal_: bool = True, lags: bool = True, rolling_: bool = True, ewma_: bool = True,
    aggregations_: bool = True, prices: bool = True, interactions: bool = True,
    order_cols: list[str] | None = None,
) -> tuple[DataFrame, list[str]]:
    """All asked families on the rows of ``df`` and the names of the new columns, nulls as 0.

    The row-order families share one numbering of the rows.
    """
    order = _order(order_cols)
    out = base = df
    if lags or rolling_ or ewma_:
        # putting them in order writes the rows, so the families below read them instead of the input plan
        alphas = _span_alphas("quantity", SPANS, "") if ewma_ else {}
        lag_by, roll_by = LAGS if lags else [], WINDOWS if rolling_ else []
        out, base = ordered.streamed(df, "quantity", order, not order_cols, lag_by, roll_by, alphas)
        if out is None:  # gaps among the quantities
            out = ordered.placed(base, [], df.columns)
            if ewma_:
                out = ordered.ewm(out, [], "quantity", alphas)
            if lags or rolling_:
                out = ordered.lag_roll(out, [], "quantity", lag_by, roll_by)
            out = out.drop("_pos")
        base = base.drop("_mid")
    if temporal_:
        out = temporal(out)
    if aggregations_:
        out = aggregations(out, base)
    if prices:
        out = price(out, base)
    if interactions:
        out = interaction(out, order[-1:], base)
    names = [c for c in out.columns if c not in df.columns]
    numeric = [
        f.name for f in out.schema.fields
        if f.name in names and isinstance(f.dataType, T.NumericType)
    ]
    return fill_zero(out, numeric), names


def feature_names(df: DataFrame, base: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in base.columns]
