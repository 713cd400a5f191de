"""Helpers of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyloom.functions.numeric import round_even
from tallyloom.sources import commits


class Family:
    """Collects queries and their SQL by name."""

    def __init__(self):
        self.queries, self.sql = {}, {}

    def add(self, name: str, sql: str | None = None):
        def register(fn):
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn
        return register


def shown(df: DataFrame, places: dict[str, int] | None = None, default: int = 6) -> DataFrame:
    """Round double columns and print dates as text, so that results compare exactly."""
    out = df
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind == "double":
            n = (places or {}).get(f.name, default)
            out = out.withColumn(f.name, round_even(F.col(f.name), n) + F.lit(0.0))
        elif kind == "date":
            out = out.withColumn(f.name, F.col(f.name).cast("string"))
    return out


def changed(spark, sf_dir: str) -> tuple:
    """Names and times of what lies in a table folder: what was made of it is stale when they differ."""
    return tuple(sorted(commits.names(spark, sf_dir)))


def r(expr: str, places: int = 6) -> str:
    """SQL of the same rounding."""
    return f"(round_even(({expr}) * 1e{places}, 0) / 1e{places} + 0e0)"


ROW_ID_SQL = """concat_ws('-', lpad(CAST(l_orderkey AS VARCHAR), 12, '0'),
      lpad(CAST(l_linenumber AS VARCHAR), 3, '0'), lpad(CAST(l_partkey AS VARCHAR), 12, '0'),
      lpad(CAST(l_suppkey AS VARCHAR), 12, '0'),
      lpad(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), 6, '0'),
      lpad(CAST(CAST(round_even(l_extendedprice * 100, 0) AS BIGINT) AS VARCHAR), 14, '0'))"""

SALES_SQL = f"""sales AS (
    SELECT concat_ws('-', 'ORD', l_orderkey, l_linenumber) AS order_id,
      CAST(l_partkey AS VARCHAR) AS product_id, p_name AS product_name, p_type AS category,
      CAST(l_suppkey AS VARCHAR) AS supplier_id, s_name AS supplier_name, r_name AS region,
      l_quantity AS quantity, l_extendedprice / l_quantity AS unit_price,
      l_discount AS discount, CAST(o_orderdate AS DATE) AS order_date,
      CAST(l_shipdate AS DATE) AS delivery_date, l_linestatus AS status,
      CAST(o_custkey AS VARCHAR) AS customer_id, n_name AS warehouse_id, l_orderkey,
      {ROW_ID_SQL} AS row_id
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
      JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
      JOIN region ON n_regionkey = r_regionkey)"""

# the same rows as untyped, dirty text
SALES_TEXT_SQL = SALES_SQL + f""", sales_text AS (
    SELECT order_id, product_id, chr(32) || chr(9) || product_name || '  ' AS product_name,
      category, supplier_id, supplier_name, region,
      CASE WHEN l_orderkey % 17 = 0 THEN 'N/A'
        WHEN l_orderkey % 23 = 0 THEN '-' || CAST(CAST(quantity AS BIGINT) AS VARCHAR)
        ELSE CAST(CAST(quantity AS BIGINT) AS VARCHAR) END AS quantity,
      CAST({r('unit_price', 2)} AS VARCHAR) AS unit_price,
      CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE CAST(discount AS VARCHAR) END AS discount,
      CAST(order_date AS VARCHAR) AS order_date,
      CASE WHEN l_orderkey % 7 = 0 THEN NULL WHEN l_orderkey % 11 = 0 THEN 'not a date'
        ELSE CAST(delivery_date AS VARCHAR) END AS delivery_date,
      status, customer_id, warehouse_id, row_id
    FROM sales)"""


def with_sales(rest: str) -> str:
    return f"WITH {SALES_SQL}{rest}"


def with_sales_text(rest: str) -> str:
    return f"WITH {SALES_TEXT_SQL}{rest}"
