"""The given star-schema tables, and the order table assembled from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.functions.numeric import round_even

# The columns an order table must have.
SALES_COLUMNS = [
    "order_id", "product_id", "product_name", "category",
    "supplier_id", "supplier_name", "region", "quantity",
    "unit_price", "discount", "order_date", "delivery_date",
    "status", "customer_id", "warehouse_id",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_id():
    """Text whose order is a total order of the line items; equal only for exact copies."""
    parts = [
        ("l_orderkey", 12), ("l_linenumber", 3), ("l_partkey", 12), ("l_suppkey", 12),
    ]
    texts = [F.lpad(F.col(c).cast("string"), n, "0") for c, n in parts]
    texts.append(F.lpad(F.col("l_quantity").cast("bigint").cast("string"), 6, "0"))
    cents = F.rint(F.col("l_extendedprice") * 100).cast("bigint")
    texts.append(F.lpad(cents.cast("string"), 14, "0"))
    return F.concat_ws("-", *texts)


def sales(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Order lines with the asked columns; only the tables these need are joined.

    Joins are plain equi joins: the planner broadcasts a dimension when its size allows.
    ``row_id`` gives every line its place in a fixed total order.
    """
    want = list(columns) or SALES_COLUMNS + ["row_id"]
    need = set(want)
    df = table(spark, sf_dir, "lineitem")
    if need & {"order_date", "customer_id"}:
        orders = table(spark, sf_dir, "orders")
        df = df.join(orders, df["l_orderkey"] == orders["o_orderkey"])
    if need & {"product_name", "category"}:
        part = table(spark, sf_dir, "part")
        df = df.join(part, df["l_partkey"] == part["p_partkey"])
    if need & {"supplier_name", "region", "warehouse_id"}:
        supplier = table(spark, sf_dir, "supplier")
        df = df.join(supplier, df["l_suppkey"] == supplier["s_suppkey"])
    if need & {"region", "warehouse_id"}:
        nation = table(spark, sf_dir, "nation")
        df = df.join(nation, df["s_nationkey"] == nation["n_nationkey"])
    if "region" in need:
        region = table(spark, sf_dir, "region")
        df = df.join(region, df["n_regionkey"] == region["r_regionkey"])
    exprs = {
        "order_id": lambda: F.concat_ws("-", F.lit("ORD"), "l_orderkey", "l_linenumber"),
        "product_id": lambda: F.col("l_partkey").cast("string"),
        "product_name": lambda: F.col("p_name"),
        "category": lambda: F.col("p_type"),
        "supplier_id": lambda: F.col("l_suppkey").cast("string"),
        "supplier_name": lambda: F.col("s_name"),
        "region": lambda: F.col("r_name"),
        "quantity": lambda: F.col("l_quantity"),
        "unit_price": lambda: F.col("l_extendedprice") / F.col("l_quantity"),
        "discount": lambda: F.col("l_discount"),
        "order_date": lambda: F.to_date("o_orderdate"),
        "delivery_date": lambda: F.to_date("l_shipdate"),
        "status": lambda: F.col("l_linestatus"),
        "customer_id": lambda: F.col("o_custkey").cast("string"),
        "warehouse_id": lambda: F.col("n_name"),
        "row_id": row_id,
        "_orderkey": lambda: F.col("l_orderkey"),
    }
    return df.select(*[exprs[c]().alias(c) for c in want])


def sales_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order table as untyped text with the kinds of dirt an order file has.

    By ``l_orderkey``: every 17th quantity is ``N/A``, every 23rd negative, every 5th
    discount is missing, every 7th delivery date is missing, every 11th order date
    has a bad text in the delivery date, and product names carry blanks and tabs.
    """
    # the key itself, not cut out of the order id: the planner copies it into every use and filter
    clean = sales(spark, sf_dir, *SALES_COLUMNS, "row_id", "_orderkey")
    key = F.col("_orderkey")

    def every(n: int):
        return key % n == 0

    q = F.col("quantity").cast("bigint").cast("string")
    return clean.select(
        "order_id", "product_id",
        F.concat(F.lit(" \t"), F.col("product_name"), F.lit("  ")).alias("product_name"),
        "category", "supplier_id", "supplier_name", "region",
        F.when(every(17), "N/A")
        .when(every(23), F.concat(F.lit("-"), q))
        .otherwise(q).alias("quantity"),
        round_even(F.col("unit_price"), 2).cast("string").alias("unit_price"),
        F.when(every(5), F.lit(None)).otherwise(F.col("discount").cast("string")).alias("discount"),
        F.col("order_date").cast("string").alias("order_date"),
        F.when(every(7), F.lit(None))
        .when(every(11), F.lit("not a date"))
        .otherwise(F.col("delivery_date").cast("string")).alias("delivery_date"),
        "status", "customer_id", "warehouse_id", "row_id",
    )
