"""Feature queries on the order table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import features, forest, ordered
from tallyloom.registered.common import Family, r, shown, with_sales
from tallyloom.sources.tables import sales

_f = Family()
QUERIES, SQL = _f.queries, _f.sql


def _sales(spark, sf_dir, *columns):
    return sales(spark, sf_dir, "row_id", *columns)


@_f.add("temporal_features", with_sales(f""", days AS (
    SELECT row_id, order_date AS d, isodow(order_date) - 1 AS dow, month(order_date) AS m
    FROM sales)
  SELECT row_id, CAST(dow AS INTEGER) AS day_of_week, CAST(day(d) AS INTEGER) AS day_of_month,
    CAST(week(d) AS INTEGER) AS week_of_year, CAST(m AS INTEGER) AS month,
    CAST(quarter(d) AS INTEGER) AS quarter, CAST(dow >= 5 AS INTEGER) AS is_weekend,
    CAST(last_day(d) = d AS INTEGER) AS is_month_end, CAST(dayofyear(d) AS INTEGER) AS day_of_year,
    {r('sin(2 * pi() * m / 12)')} AS sin_month, {r('cos(2 * pi() * m / 12)')} AS cos_month,
    {r('sin(2 * pi() * dow / 7)')} AS sin_day_of_week,
    {r('cos(2 * pi() * dow / 7)')} AS cos_day_of_week FROM days"""))
def temporal_features(spark, sf_dir):
    df = features.temporal(_sales(spark, sf_dir, "order_date"))
    return shown(df.drop("order_date"))


_PRICE_SQL = f"""{r('(unit_price - avg(unit_price) OVER ()) / (stddev_samp(unit_price) OVER () + 1e-8)')}
      AS unit_price_normalized, {r('ln(1 + unit_price)')} AS unit_price_log,
    CAST(discount > 0 AS INTEGER) AS has_discount, discount AS discount_rate,
    {r('unit_price * quantity', 4)} AS revenue_per_unit"""


@_f.add("price_features", with_sales(f" SELECT row_id, {_PRICE_SQL} FROM sales"))
def price_features(spark, sf_dir):
    df = features.price(_sales(spark, sf_dir, "quantity", "unit_price", "discount"))
    return shown(df.drop("quantity", "unit_price", "discount"), {"revenue_per_unit": 4})


@_f.add("interaction_features", with_sales(f""", codes AS (
    SELECT category, region, row_number() OVER (ORDER BY min(row_id)) - 1 AS code
    FROM sales GROUP BY category, region)
  SELECT row_id, {r('quantity * unit_price', 4)} AS qty_price_interaction,
    {r('quantity * discount')} AS qty_discount_interaction, code AS category_region_group
  FROM sales JOIN codes USING (category, region)"""))
def interaction_features(spark, sf_dir):
    df = features.interaction(
        _sales(spark, sf_dir, "quantity", "unit_price", "discount", "category", "region"))
    return shown(df.select("row_id", "qty_price_interaction", "qty_discount_interaction",
                           "category_region_group"), {"qty_price_interaction": 4})


def _group_sql(key: str) -> str:
    rev = "quantity * unit_price * (1 - discount)"
    return with_sales(f""", g AS (SELECT {key}, sum(quantity) AS qs, avg(quantity) AS qm,
      sum({rev}) AS rs, avg({rev}) AS rm FROM sales GROUP BY {key})
    SELECT row_id, {r('qs')} AS {key}_qty_sum, {r('qm')} AS {key}_qty_mean,
      {r('rs', 2)} AS {key}_revenue_sum, {r('rm', 3)} AS {key}_revenue_mean
    FROM sales JOIN g USING ({key})""")


def _group_features(spark, sf_dir, key):
    df = features.aggregations(
        _sales(spark, sf_dir, key, "quantity", "unit_price", "discount"))
    names = [f"{key}_{v}_{a}" for v in ("qty", "revenue") for a in ("sum", "mean")]
    return shown(df.select("row_id", *names),
                 {f"{key}_revenue_sum": 2, f"{key}_revenue_mean": 3})


@_f.add("cat_agg_features", _group_sql("category"))
def cat_agg_features(spark, sf_dir):
    return _group_features(spark, sf_dir, "category")


@_f.add("region_agg_features", _group_sql("region"))
def region_agg_features(spark, sf_dir):
    return _group_features(spark, sf_dir, "region")


@_f.add("supplier_agg_feature", with_sales(f"""
  SELECT row_id, {r('avg(quantity) OVER (PARTITION BY supplier_id)')} AS supplier_avg_qty
  FROM sales"""))
def supplier_agg_feature(spark, sf_dir):
    df = features.aggregations(
        _sales(spark, sf_dir, "supplier_id", "quantity", "unit_price", "discount"))
    return shown(df.select("row_id", "supplier_avg_qty"))


@_f.add("group_transform", with_sales(f"""
  SELECT row_id, {r('sum(quantity) OVER (PARTITION BY product_id)')} AS product_qty_sum,
    {r('max(quantity) OVER (PARTITION BY product_id)')} AS product_qty_max,
    count(*) OVER (PARTITION BY product_id) AS product_rows FROM sales"""))
def group_transform(spark, sf_dir):
    df = features.group_stats(_sales(spark, sf_dir, "product_id", "quantity"), "product_id", {
        "product_qty_sum": F.sum("quantity"), "product_qty_max": F.max("quantity"),
        "product_rows": F.count("*"),
    })
    return shown(df.drop("product_id", "quantity"))


def _ordered_sql(body, key: str | None = None) -> str:
    part = f"PARTITION BY {key} " if key else ""
    return with_sales(f""" SELECT row_id, {body} FROM sales
      WINDOW w AS ({part}ORDER BY order_date, row_id)""")


def _lag_body(suffix=""):
    return ", ".join(f"coalesce(lag(quantity, {n}) OVER w, -1e0) AS quantity_lag_{n}{suffix}"
                     for n in features.LAGS)


def _lags(df, suffix=""):
    names = [f"quantity_lag_{n}{suffix}" for n in features.LAGS]
    return df.select("row_id", *[F.coalesce(F.col(c), F.lit(-1.0)).alias(c) for c in names])


@_f.add("lag_features", _ordered_sql(_lag_body()))
def lag_features(spark, sf_dir):
    return _lags(features.lag(_sales(spark, sf_dir, "order_date", "quantity")))


@_f.add("lag_features_by_group", with_sales(f"""
  SELECT row_id, {', '.join(
      f"coalesce(lag(quantity, {n}) OVER {w}, -1e0) AS quantity_lag_{n}_{g}"
      for w, g in (('wc', 'category'), ('wr', 'region')) for n in features.LAGS)} FROM sales
  WINDOW wc AS (PARTITION BY category ORDER BY order_date, row_id),
    wr AS (PARTITION BY region ORDER BY order_date, row_id)"""))
def lag_features_by_group(spark, sf_dir):
    df = features.lag(_sales(spark, sf_dir, "order_date", "quantity", "category", "region"),
                      group_cols=["category", "region"])
    names = [f"quantity_lag_{n}_{g}" for g in ("category", "region") for n in features.LAGS]
    return df.select("row_id", *[F.coalesce(F.col(c), F.lit(-1.0)).alias(c) for c in names])


def _rolling_sql(key: str | None) -> str:
    part = f"PARTITION BY {key} " if key else ""
    suffix = f"_{key}" if key else ""
    cols, frames = [], []
    for n in features.WINDOWS:
        frames.append(f"w{n} AS ({part}ORDER BY order_date, row_id "
                      f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)")
        cols += [
            f"{r(f'avg(quantity) OVER w{n}')} AS quantity_rolling_mean_{n}{suffix}",
            f"{r(f'coalesce(stddev_samp(quantity) OVER w{n}, 0e0)')} "
            f"AS quantity_rolling_std_{n}{suffix}",
            f"max(quantity) OVER w{n} AS quantity_rolling_max_{n}{suffix}",
        ]
    return with_sales(f" SELECT row_id, {', '.join(cols)} FROM sales WINDOW {', '.join(frames)}")


def _rolled(df, drop):
    return shown(df.drop("order_date", "quantity", *drop).fillna(0))


@_f.add("rolling_stats", _rolling_sql(None))
def rolling_stats(spark, sf_dir):
    return _rolled(features.rolling(_sales(spark, sf_dir, "order_date", "quantity")), [])


@_f.add("rolling_stats_by_group", _rolling_sql("category"))
def rolling_stats_by_group(spark, sf_dir):
    df = _sales(spark, sf_dir, "order_date", "quantity", "category")
    return _rolled(features.rolling(df, group_cols=["category"]), ["category"])


# Means of whole numbers by halving can end exactly on a rounding edge; this moves them off.
OFF_EDGE = 1e-8


def _off_edge(df):
    return df.withColumns({c: F.col(c) + OFF_EDGE for c in df.columns if "_ewma_" in c})


def _ewma_sql(key: str | None) -> str:
    """Weighted sum over the rows before; weights below 1e-17 add nothing to a double."""
    part = f"PARTITION BY {key} " if key else ""
    same = f"AND b.{key} = a.{key}" if key else ""
    suffix = f"_{key}" if key else ""
    ctes, names = [], []
    for n, reach in zip(features.SPANS, (160, 620)):
        a = f"(2e0 / {n + 1})"
        ctes.append(f"""e{n} AS (SELECT a.row_id, sum(pow(1 - {a}, a.p - b.p)
            * CASE WHEN b.p = 0 THEN 1e0 ELSE {a} END * b.quantity) AS e
          FROM o a JOIN o b ON b.p BETWEEN a.p - {reach} AND a.p {same} GROUP BY a.row_id)""")
        names.append(f"{r(f'e{n}.e + {OFF_EDGE}')} AS quantity_ewma_{n}{suffix}")
    key_col = f"{key}, " if key else ""
    return with_sales(f""", o AS (SELECT {key_col} row_id, quantity,
        row_number() OVER ({part}ORDER BY order_date, row_id) - 1 AS p FROM sales),
      {', '.join(ctes)}
    SELECT e7.row_id, {', '.join(names)} FROM e7 JOIN e30 USING (row_id)""")


@_f.add("ewma_features", _ewma_sql(None))
def ewma_features(spark, sf_dir):
    df = features.ewma(_sales(spark, sf_dir, "order_date", "quantity"))
    return shown(_off_edge(df.drop("order_date", "quantity")))


@_f.add("ewma_features_by_group", _ewma_sql("supplier_id"))
def ewma_features_by_group(spark, sf_dir):
    df = features.ewma(_sales(spark, sf_dir, "order_date", "quantity", "supplier_id"),
                       group_cols=["supplier_id"])
    return shown(_off_edge(df.drop("order_date", "quantity", "supplier_id")))


def _ewma_gaps_sql() -> str:
    """Every value against those up to a reach before it, weights from running sums of logarithms."""
    ctes, names = [], []
    for n, reach in zip(features.SPANS, (160, 620)):
        a = f"(2e0 / {n + 1})"
        ctes.append(f"""f{n} AS (SELECT vi, CASE WHEN vi = 0 THEN 0e0 ELSE ln(w / (w + {a})) END AS l,
            CASE WHEN vi = 0 THEN q ELSE q * {a} / (w + {a}) END AS b
          FROM (SELECT *, pow(1 - {a}, p - pp) AS w FROM v)),
        s{n} AS (SELECT *, sum(l) OVER (ORDER BY vi) AS s FROM f{n}),
        e{n} AS (SELECT x.vi, sum(exp(x.s - y.s) * y.b) AS e FROM s{n} x JOIN s{n} y
          ON y.vi BETWEEN x.vi - {reach} AND x.vi GROUP BY x.vi)""")
        names.append(f"{r(f'coalesce(e{n}.e, -1e0) + {OFF_EDGE}', 4)} AS quantity_ewma_{n}")
    return with_sales(f""", o AS (SELECT row_id, CASE WHEN l_orderkey % 7 <> 0 THEN quantity END AS q,
        row_number() OVER (ORDER BY order_date, row_id) - 1 AS p FROM sales),
      v AS (SELECT p, q, lag(p) OVER (ORDER BY p) AS pp, row_number() OVER (ORDER BY p) - 1 AS vi
        FROM o WHERE q IS NOT NULL),
      {', '.join(ctes)},
      c AS (SELECT row_id, count(q) OVER (ORDER BY p) - 1 AS vi FROM o)
    SELECT row_id, {', '.join(names)} FROM c LEFT JOIN e7 USING (vi) LEFT JOIN e30 USING (vi)""")


@_f.add("ewma_features_gaps", _ewma_gaps_sql())
def ewma_features_gaps(spark, sf_dir):
    """Every seventh order has no quantity. Four places: the SQL takes differences of
    sums of logarithms over the whole series, which leaves it about 2e-11 off."""
    df = _sales(spark, sf_dir, "order_id", "order_date", "quantity").withColumn(
        "quantity", F.when(F.split("order_id", "-")[1].cast("bigint") % 7 != 0, F.col("quantity")))
    return shown(_off_edge(features.ewma(df).drop("order_id", "order_date", "quantity").fillna(-1.0)), default=4)


@_f.add("target_lead", with_sales("""
  , d AS (SELECT order_date AS t, sum(quantity) AS s, max(quantity) AS m FROM sales
    GROUP BY order_date)
  SELECT strftime(t, '%Y-%m-%d') AS t, coalesce(lead(s, 7) OVER (ORDER BY t), -1e0) AS target_sum,
    coalesce(lead(m, 7) OVER (ORDER BY t), -1e0) AS target_max FROM d"""))
def target_lead(spark, sf_dir):
    df = sales(spark, sf_dir, "order_date", "quantity")
    total = features.target(df, agg_func="sum").select("t", F.col("target").alias("target_sum"))
    most = features.target(df, agg_func="max").select("t", F.col("target").alias("target_max"))
    return shown(total.join(most, "t").fillna(-1.0))


@_f.add("fill_zero", with_sales(f"""
  SELECT row_id, {r('coalesce(stddev_samp(quantity) OVER (PARTITION BY order_date), 0e0)')}
    AS quantity_std FROM sales"""))
def fill_zero(spark, sf_dir):
    df = features.group_stats(_sales(spark, sf_dir, "order_date", "quantity"), "order_date",
                              {"quantity_std": F.stddev_samp("quantity")})
    return shown(features.fill_zero(df, ["quantity_std"]).select("row_id", "quantity_std"))


@_f.add("feature_select", with_sales(f"""
  SELECT row_id, CAST(month(order_date) AS INTEGER) AS month,
    CAST(isodow(order_date) >= 6 AS INTEGER) AS is_weekend, {_PRICE_SQL},
    coalesce(lag(quantity, 7) OVER w, 0e0) AS quantity_lag_7,
    coalesce(lag(quantity, 30) OVER w, 0e0) AS quantity_lag_30
  FROM sales WINDOW w AS (ORDER BY order_date, row_id)"""))
def feature_select(spark, sf_dir):
    df = _sales(spark, sf_dir, "order_date", "quantity", "unit_price", "discount")
    wide, names = features.all_features(
        df, rolling_=False, ewma_=False, aggregations_=False, interactions=False)
    wanted = ["month", "is_weekend", "unit_price_normalized", "unit_price_log", "has_discount",
              "discount_rate", "revenue_per_unit", "quantity_lag_7", "quantity_lag_30"]
    return shown(wide.select("row_id", *[c for c in names if c in wanted]), {"revenue_per_unit": 4})


_ALL_SQL = "SELECT * FROM " + " JOIN ".join(f"({part}) AS p{i}" if i == 0 else f"({part}) AS p{i} USING (row_id)"
    for i, part in enumerate([
        _ewma_sql(None), _ordered_sql(_lag_body().replace("-1e0", "0e0")), _rolling_sql(None),
        SQL["temporal_features"], SQL["cat_agg_features"], SQL["region_agg_features"],
        SQL["supplier_agg_feature"], SQL["price_features"], SQL["interaction_features"]]))


@_f.add("all_features", _ALL_SQL)
def all_features(spark, sf_dir):
    """All features of all families."""
    df = _sales(spark, sf_dir, "order_date", "quantity", "unit_price", "discount", "category",
                "region", "supplier_id")
    wide, names = features.all_features(df)
    places = {"revenue_per_unit": 4, "qty_price_interaction": 4}
    for key in ("category", "region"):
        places |= {f"{key}_revenue_sum": 2, f"{key}_revenue_mean": 3}
    return shown(_off_edge(wide.select("row_id", *names)), places)


@_f.add("split_random", with_sales("""
  SELECT row_id, CASE WHEN substr(md5(row_id || '-42'), 1, 8) < '33333333' THEN 'test'
    ELSE 'train' END AS split FROM sales"""))
def split_random(spark, sf_dir):
    return forest.split_random(_sales(spark, sf_dir))


@_f.add("standard_scale", with_sales(f"""
  , s AS (SELECT *, substr(md5(row_id || '-42'), 1, 8) >= '33333333' AS is_train FROM sales),
  t AS (SELECT avg(quantity) AS qm, stddev_pop(quantity) AS qs, avg(unit_price) AS pm,
    stddev_pop(unit_price) AS ps FROM s WHERE is_train)
  SELECT row_id, {r('(quantity - qm) / qs')} AS quantity_scaled,
    {r('(unit_price - pm) / ps')} AS unit_price_scaled FROM s, t"""))
def standard_scale(spark, sf_dir):
    df = forest.split_random(_sales(spark, sf_dir, "quantity", "unit_price"))
    out = forest.standard_scale(df, ["quantity", "unit_price"], F.col("split") == "train")
    return shown(out.select("row_id", "quantity_scaled", "unit_price_scaled"))


@_f.add("row_positions_by_product", with_sales("""
  SELECT row_id, row_number() OVER (PARTITION BY product_id ORDER BY order_date, row_id) - 1
    AS place FROM sales"""))
def row_positions_by_product(spark, sf_dir):
    df = _sales(spark, sf_dir, "order_date", "product_id")
    return ordered.positions(df, ["product_id"], ["order_date", "row_id"], unique=True).select(
        "row_id", F.col("_pos").alias("place"))
