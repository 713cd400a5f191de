"""Cleaning queries on the order table as dirty text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import clean, ordered, requests, series
from tallyloom.registered.common import Family, r, shown, with_sales, with_sales_text
from tallyloom.sources.tables import SALES_COLUMNS, sales, sales_text, table

_f = Family()
QUERIES, SQL = _f.queries, _f.sql

NUMBERS = ("TRY_CAST(quantity AS DOUBLE) AS q, TRY_CAST(unit_price AS DOUBLE) AS p, "
           "TRY_CAST(discount AS DOUBLE) AS d")
FIRST_SQL = """, first_rows AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY row_id) AS rn
      FROM sales_text) WHERE rn = 1)"""


@_f.add("validate_columns", with_sales_text(" SELECT count(*) AS n_rows FROM sales_text"))
def validate_columns(spark, sf_dir):
    return clean.validate_columns(sales_text(spark, sf_dir)).agg(F.count("*").alias("n_rows"))


@_f.add("clean_numeric", with_sales_text(f""", n AS (SELECT *, {NUMBERS} FROM sales_text)
  SELECT order_id, row_id, CAST(q AS BIGINT) AS quantity, p AS unit_price,
    coalesce(d, CAST(0 AS DOUBLE)) AS discount
  FROM n WHERE q IS NOT NULL AND p IS NOT NULL AND q >= 0 AND p >= 0"""))
def clean_numeric(spark, sf_dir):
    return clean.clean_numeric(sales_text(spark, sf_dir)).select(
        "order_id", "row_id", "quantity", "unit_price", "discount")


@_f.add("drop_report", with_sales_text(FIRST_SQL + f""",
  n AS (SELECT {NUMBERS} FROM first_rows)
  SELECT 'duplicate order_id' AS rule,
    (SELECT count(*) FROM sales_text) - (SELECT count(*) FROM first_rows) AS dropped
  UNION ALL SELECT 'unparseable quantity/unit_price', count(*) FROM n
    WHERE q IS NULL OR p IS NULL
  UNION ALL SELECT 'negative quantity/unit_price', count(*) FROM n WHERE q < 0 OR p < 0"""))
def drop_report(spark, sf_dir):
    return clean.drop_report(sales_text(spark, sf_dir), "row_id")


@_f.add("profile_nulls", with_sales_text(" " + " UNION ALL ".join(
    f"""SELECT {i} AS position, '{c}' AS "column", 'string' AS type, count(*) AS "rows",
    count(*) - count({c}) AS nulls FROM sales_text""" for i, c in enumerate(SALES_COLUMNS))))
def profile_nulls(spark, sf_dir):
    return clean.profile_nulls(sales_text(spark, sf_dir).select(*SALES_COLUMNS))


@_f.add("clean_dates", with_sales_text("""
  SELECT order_id, row_id, strftime(TRY_CAST(order_date AS DATE), '%Y-%m-%d') AS order_date,
    strftime(TRY_CAST(delivery_date AS DATE), '%Y-%m-%d') AS delivery_date FROM sales_text"""))
def clean_dates(spark, sf_dir):
    return shown(clean.clean_dates(sales_text(spark, sf_dir)).select(
        "order_id", "row_id", "order_date", "delivery_date"))


@_f.add("clean_strings", with_sales_text("""
  SELECT row_id, regexp_replace(regexp_replace(product_name, '^\\s+', ''), '\\s+$', '')
    AS product_name, trim(supplier_name) AS supplier_name FROM sales_text"""))
def clean_strings(spark, sf_dir):
    return clean.clean_strings(sales_text(spark, sf_dir)).select(
        "row_id", "product_name", "supplier_name")


@_f.add("dedup_orders", with_sales_text(FIRST_SQL + " SELECT order_id, row_id FROM first_rows"))
def dedup_orders(spark, sf_dir):
    return clean.dedup_orders(sales_text(spark, sf_dir), "row_id").select("order_id", "row_id")


_CLEAN_SQL = FIRST_SQL + f""", n AS (SELECT *, {NUMBERS} FROM first_rows),
  kept AS (SELECT *, coalesce(d, CAST(0 AS DOUBLE)) AS d0,
      TRY_CAST(order_date AS DATE) AS od, TRY_CAST(delivery_date AS DATE) AS dd FROM n
    WHERE q IS NOT NULL AND p IS NOT NULL AND q >= 0 AND p >= 0)"""


@_f.add("derived_columns", with_sales_text(_CLEAN_SQL + f"""
  SELECT order_id, {r('q * p * (1 - d0)', 2)} AS total_price,
    CAST(coalesce(dd - od, -1) AS INTEGER) AS lead_time_days FROM kept"""))
def derived_columns(spark, sf_dir):
    return clean.preprocess(sales_text(spark, sf_dir), "row_id").select(
        "order_id", "total_price", F.coalesce("lead_time_days", F.lit(-1)).alias("lead_time_days"))


@_f.add("preprocess", with_sales_text(_CLEAN_SQL + f"""
  SELECT order_id, product_id,
    regexp_replace(regexp_replace(product_name, '^\\s+', ''), '\\s+$', '') AS product_name,
    category, supplier_id, supplier_name, region, CAST(q AS BIGINT) AS quantity,
    p AS unit_price, d0 AS discount, strftime(od, '%Y-%m-%d') AS order_date,
    coalesce(strftime(dd, '%Y-%m-%d'), '') AS delivery_date, status, customer_id, warehouse_id,
    {r('q * p * (1 - d0)', 2)} AS total_price,
    CAST(coalesce(dd - od, -1) AS INTEGER) AS lead_time_days FROM kept"""))
def preprocess(spark, sf_dir):
    df = clean.preprocess(sales_text(spark, sf_dir), "row_id").drop("row_id")
    return df.withColumns({
        "order_date": F.col("order_date").cast("string"),
        "delivery_date": F.coalesce(F.col("delivery_date").cast("string"), F.lit("")),
        "lead_time_days": F.coalesce("lead_time_days", F.lit(-1)),
    })


@_f.add("revenue", with_sales(f"""
  SELECT row_id, {r('quantity * unit_price * (1 - discount)', 4)} AS revenue FROM sales"""))
def revenue(spark, sf_dir):
    df = sales(spark, sf_dir, "row_id", "quantity", "unit_price", "discount")
    return shown(series.revenue(df).select("row_id", "revenue"), default=4)


@_f.add("sort_by_date", with_sales("""
  SELECT order_id, row_id, row_number() OVER (ORDER BY order_date, row_id) - 1 AS place
  FROM sales"""))
def sort_by_date(spark, sf_dir):
    df = sales(spark, sf_dir, "order_id", "order_date", "row_id")
    return ordered.positions(df, [], ["order_date", "row_id"], unique=True).select(
        "order_id", "row_id", F.col("_pos").alias("place"))


@_f.add("request_split", """
  SELECT conv_id, turn, concat_ws(',',
    CASE WHEN length(text) < 1 OR text IS NULL THEN 'query' END,
    CASE WHEN turn % 25 < 1 OR turn % 25 > 20 THEN 'num_retrieval' END,
    CASE WHEN length(text) < 50 OR length(text) > 2000 THEN 'max_tokens' END,
    CASE WHEN (conv_id % 13) / 10e0 < 0e0 OR (conv_id % 13) / 10e0 > 1e0
      THEN 'temperature' END) AS rejected
  FROM conversations""")
def request_split(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.col("text").alias("query"),
        (F.col("turn") % 25).alias("num_retrieval"), F.length("text").alias("max_tokens"),
        ((F.col("conv_id") % 13) / F.lit(10.0)).alias("temperature"))
    return requests.split_ask(asked).select("conv_id", "turn", "rejected")


@_f.add("request_split_forecast", """
  SELECT event_id, concat_ws(',', CASE WHEN user_id < 1 OR user_id > 365 THEN 'periods' END,
    CASE WHEN upper(substr(event_type, 1, 1)) NOT IN ('D', 'W', 'M') THEN 'freq' END,
    CASE WHEN event_id % 3 = 0 THEN 'methods' END,
    CASE WHEN event_id % 5 = 0 THEN 'date_col' END,
    CASE WHEN event_id % 7 = 0 THEN 'value_col' END) AS rejected
  FROM events""")
def request_split_forecast(spark, sf_dir):
    key = F.col("event_id")
    asked = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("periods"),
        F.upper(F.substring("event_type", 1, 1)).alias("freq"),
        F.when(key % 3 == 0, F.array(F.lit("sma"), F.lit("bogus")))
        .when(key % 3 == 1, F.array(F.lit("es"))).alias("methods"),
        F.when(key % 5 == 0, "ship_date").alias("date_col"),
        F.when(key % 7 == 0, "order_id").alias("value_col"))
    return requests.split_forecast(asked).select("event_id", "rejected")
