"""Cleaning of order tables; every step is a projection, a filter or one keyed shuffle."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tallyloom.functions.numeric import round_even
from tallyloom.sources.tables import SALES_COLUMNS

NUMERIC_COLUMNS = ["quantity", "unit_price", "discount"]
DATE_COLUMNS = ["order_date", "delivery_date"]


def validate_columns(df: DataFrame, required: list[str] | None = None) -> DataFrame:
    """Raise if a required column is missing; looks at the schema only."""
    missing = [c for c in (required or SALES_COLUMNS) if c not in df.columns]
    if missing:
        raise ValueError(f"the table lacks the columns {missing}")
    return df


def with_input_ordinal(df: DataFrame, name: str = "_ord") -> DataFrame:
    """Place of a row in the input; call straight after a scan.

    For files: the file's name, the start of the split and a running number, so the order is that
    of the files whatever the size of the splits and however they are packed into tasks. Rows
    that do not come from files are numbered as they are.
    """
    running = F.monotonically_increasing_id()
    try:
        split = df.select("_metadata.file_path", "_metadata.file_block_start").columns
    except AnalysisException:
        return df.withColumn(name, running)
    return df.withColumn(name, F.struct(*[F.col(f"_metadata.{c}") for c in split], running.alias("row")))


def dedup_orders(df: DataFrame, order_col: str = "_ord", key: str = "order_id") -> DataFrame:
    """First row of each order id.

    The planner keeps one row per id before the shuffle, so many copies of one id do not
    pile up in a task.
    """
    first = Window.partitionBy(key).orderBy(order_col)
    return df.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


def _string_fields(df: DataFrame, keep: tuple[str, ...] = ()) -> list[str]:
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name not in keep
    ]


# White space of all scripts, by rule from the Unicode data.
_SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(c: Column) -> Column:
    """Remove white space of any kind on both sides; texts without any at their ends are left alone."""
    return F.when(c.rlike(r"^[\s\p{Z}\x1c-\x1f\x85]|[\s\p{Z}\x1c-\x1f\x85]$"), F.btrim(c, F.lit(_SPACES))).otherwise(c)


def clean_strings(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.withColumns({c: strip(F.col(c)) for c in _string_fields(df, keep)})


def as_number(c: Column, is_text: bool = True) -> Column:
    """Number in a text, null for anything else (also for NaN).

    A cast alone would also take "12d", "3f" and hexadecimal numbers.
    """
    x = c.try_cast("double")
    if is_text:
        x = F.when(~c.rlike(r"[0-9.][dDfF]\s*$|[xX]"), x)
    return F.nanvl(x, F.lit(None).cast("double"))


def coerce_numeric(df: DataFrame) -> DataFrame:
    text = _string_fields(df)
    return df.withColumns({
        c: as_number(F.col(c), c in text) for c in NUMERIC_COLUMNS if c in df.columns
    })


def _unparsed() -> Column:
    return F.col("quantity").isNull() | F.col("unit_price").isNull()


def _negative() -> Column:
    return (F.col("quantity") < 0) | (F.col("unit_price") < 0)


def clean_numeric(df: DataFrame) -> DataFrame:
    """Numbers from text; no discount is 0; rows without or with negative values go.

    One test a column drops both, as the planner works the number out anew for each.
    """
    return (
        coerce_numeric(df)
        .withColumn("discount", F.coalesce("discount", F.lit(0.0)))
        .filter((F.col("quantity") >= 0) & (F.col("unit_price") >= 0))
        .withColumn("quantity", F.col("quantity").cast("bigint"))
    )


def numeric_only(df: DataFrame) -> DataFrame:
    """Quantity to number, rows without one go, negatives stay, discount stays as it is."""
    return coerce_numeric(df).filter(F.col("quantity").isNotNull())


def clean_dates(df: DataFrame, formats: list[str] | None = None) -> DataFrame:
    """Dates from text; what is no date becomes null, rows stay.

    ISO dates are read unless other ``formats`` (date patterns, tried in turn) are given.
    """
    def parsed(c: str) -> Column:
        if not formats:
            return F.try_to_timestamp(F.col(c))
        return F.coalesce(*[F.try_to_timestamp(F.col(c), F.lit(f)) for f in formats])

    return df.withColumns({c: F.to_date(parsed(c)) for c in DATE_COLUMNS if c in df.columns})


def add_derived(df: DataFrame) -> DataFrame:
    """total_price to 2 places and lead_time_days between the two dates."""
    price = F.col("quantity") * F.col("unit_price") * (1 - F.col("discount"))
    return df.withColumns({
        "total_price": round_even(price, 2),
        "lead_time_days": F.datediff("delivery_date", "order_date"),
    })


def preprocess(df: DataFrame, order_col: str = "_ord") -> DataFrame:
    """Validate, dedup, strip, numbers, dates, derived columns – one lazy plan, one shuffle."""
    validate_columns(df)
    return (
        dedup_orders(df, order_col)
        .transform(clean_strings, (order_col,))
        .transform(clean_numeric)
        .transform(clean_dates)
        .transform(add_derived)
    )


def drop_report(df: DataFrame, order_col: str = "_ord") -> DataFrame:
    """Rows removed by each rule, in the order the rules run: ``(rule, dropped)``."""
    n = coerce_numeric(df)
    first = dedup_orders(n, order_col)
    kept = first.agg(
        F.count("*").alias("kept"),
        F.count_if(_unparsed()).alias("unparsed"),
        F.count_if(~_unparsed() & _negative()).alias("negative"),
    )
    total = df.agg(F.count("*")).scalar()
    return kept.select(F.inline(F.array(
        F.struct(F.lit("duplicate order_id").alias("rule"),
                 (total - F.col("kept")).alias("dropped")),
        F.struct(F.lit("unparseable quantity/unit_price").alias("rule"),
                 F.col("unparsed").alias("dropped")),
        F.struct(F.lit("negative quantity/unit_price").alias("rule"),
                 F.col("negative").alias("dropped")),
    )))


def profile_nulls(df: DataFrame) -> DataFrame:
    """Per column: position, type, rows and null count; one scan, no shuffle of rows."""
    fields = df.schema.fields
    counts = df.agg(
        F.count("*").alias("_rows"),
        *[F.count_if(F.col(f.name).isNull()).alias(f"_n{i}") for i, f in enumerate(fields)],
    )
    return counts.select(F.inline(F.array(*[
        F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.col("_rows").alias("rows"), F.col(f"_n{i}").alias("nulls"),
        )
        for i, f in enumerate(fields)
    ])))
