"""Order files and result tables."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.operators import clean, forecast
from tallyloom.sources.tables import SALES_COLUMNS

# Files whose first lines a task reads, at least, if there are many.
FILES_A_TASK = 200
# Small files that a task writes, about, into one sub-folder.
FILES_A_SHELF = 500

# Rows of a written order file: compressed, it is read by one task.
ORDER_FILE_ROWS = 1_000_000

# Quotes inside a quoted field are doubled.
_QUOTES = {"quote": '"', "escape": '"'}


def write_sales_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Order files, compressed and of bounded size."""
    (
        df.select(*(columns or SALES_COLUMNS)).write.mode("overwrite").option("header", "true")
        .options(**_QUOTES)
        .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
        .option("compression", "gzip").option("maxRecordsPerFile", ORDER_FILE_ROWS)
        .csv(path)
    )


def write_each(rows: DataFrame, path: str, suffix: str) -> None:
    """Every row of ``rows (text)`` as a file with this one line (null: an empty one), on shelves (sub-folders).

    A task opens the files of one shelf itself, so their number grows with the rows and no commit of the driver
    moves them one by one. A file gets its name when it is whole, the same when the task runs again.
    """
    spark = rows.sparkSession
    shelves = max(spark.sparkContext.defaultParallelism, -(-rows.count() // FILES_A_SHELF))
    try:
        store, base = fs.FileSystem.from_uri(path)
    except (ValueError, OSError) as e:
        raise ValueError(f"the tasks cannot write {path}: it must be a folder that pyarrow.fs knows "
                         "(a path, file:, hdfs:, s3:, gs: or abfs:)") from e
    store.create_dir(base, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, task = fs.FileSystem.from_uri(path)[0], TaskContext.get()
        shelf, place = f"{base}/shelf={task.partitionId()}", 0
        at.create_dir(shelf, recursive=True)
        for b in batches:
            for text in b.column(0).to_pylist():
                name = f"{place:05}{suffix}"
                unfinished = f"{shelf}/.{name}-{task.taskAttemptId()}"
                with at.open_output_stream(unfinished) as f:
                    f.write((text or b"") + b"\n")
                at.move(unfinished, f"{shelf}/{name}")
                place += 1
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    rows.select(F.col("text").cast("binary")).repartition(shelves).mapInArrow(write, "n long").agg(F.sum("n")).collect()


# Compressed files whose first line a task can read without Spark's readers.
_PLAIN = (".csv", ".txt", ".gz", ".bz2", ".zst", ".lz4")


def _names(line: str | None) -> str | None:
    """The names in a header line as a JSON list; null for an empty file."""
    names = next(csv.reader([(line or "").removeprefix("\ufeff").rstrip("\r\n")]), [])
    return json.dumps(names) if names else None


def _opened(files: DataFrame) -> DataFrame:
    """(file, header): every task opens its share of the files and reads a line of each."""
    def first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = b.column(0).to_pylist()
            headers = []
            for path in paths:
                store, name = fs.FileSystem.from_uri(path)
                with io.TextIOWrapper(store.open_input_stream(name, compression="detect"), "utf-8") as lines:
                    headers.append(_names(lines.readline()))
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(headers, pa.string())], ["file", "header"])

    return files.mapInArrow(first_lines, "file string, header string")


def _scanned(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, header) by Spark's own reader, which reaches every file but reads all lines."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value",
        F.monotonically_increasing_id().alias("place"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            headers = [_names(line) for line in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(headers, pa.string())], ["file", "header"])

    first = lines.filter("at = 0").groupBy("file").agg(F.min_by("value", "place").alias("value"))
    return first.mapInArrow(named, "file string, header string")


def headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, header) of every order file: the names in its first line as a JSON list, null if empty.

    The driver lists the files; the tasks read the lines. Where a task cannot open a file by itself (a store
    that only Spark's readers know, a compression of Hadoop's own), they come from a scan of the lines.
    """
    names = spark.read.text(path).inputFiles()
    try:
        for store in {n.partition(":")[0] for n in names}:
            fs.FileSystem.from_uri(next(n for n in names if n.startswith(store)))
    except (ValueError, OSError):
        return _scanned(spark, path)
    if not all(n.rpartition("/")[2].lower().endswith(_PLAIN) for n in names):
        return _scanned(spark, path)
    tasks = min(len(names), max(spark.sparkContext.defaultParallelism, len(names) // FILES_A_TASK)) or 1
    return _opened(spark.createDataFrame([(n,) for n in names], "file string").repartition(tasks))


def read_sales_csv(
    spark: SparkSession, path: str | list[str], multi_line: bool = False, ordinal: str | None = None
) -> DataFrame:
    """Order files, all columns as text under the names of their headers.

    The files may have their columns in different orders: those with one header are one scan, and the scans
    are joined by name; a column that a file lacks is null. The first lines are read by the tasks; the
    driver lists the files and gets one row per header, with the files' names. A missing file is an error.
    ``multi_line`` allows line ends inside quotes, at the price that a file is read by one task. ``ordinal``
    names a column with the place of each row: file name, then position in the file.
    """
    by_header = headers(spark, path).filter("header IS NOT NULL").groupBy("header").agg(
        F.sort_array(F.collect_list("file")).alias("files")).collect()
    reader = spark.read.option("header", "true").option("multiLine", multi_line).options(**_QUOTES)
    scans = []
    for header, files in sorted((tuple(json.loads(h)), f) for h, f in by_header):
        # listed as addresses, read as paths
        scans.append(reader.schema(", ".join(f"`{c}` string" for c in header)).csv([unquote(f) for f in files]))
    if not scans:
        return reader.csv(path)
    if ordinal:
        scans = [clean.with_input_ordinal(s, ordinal) for s in scans]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)


def read_sales_numeric(spark: SparkSession, path: str) -> DataFrame:
    """Order file with numeric quantity; rows without one are dropped, negatives stay."""
    return clean.numeric_only(read_sales_csv(spark, path))


def write_embeddings(df: DataFrame, path: str) -> None:
    df.withColumn("embedding", F.col("embedding").cast("array<float>")).write.mode(
        "overwrite").parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def forecast_json(df: DataFrame, series_key: list[str] | None = None) -> DataFrame:
    """One JSON object per series: method → list of values in step order."""
    key = series_key or []
    arrays = forecast.as_arrays(df, key)
    entry = F.array_sort(F.collect_list(F.struct("method", "values")))
    return arrays.groupBy(*key).agg(F.to_json(F.map_from_entries(entry)).alias("forecast"))


# A file of forecasts holds at most so many rows, a row group about so many bytes.
FORECAST_FILE_ROWS = 5_000_000
FORECAST_GROUP_BYTES = 16 << 20


def write_forecast(df: DataFrame, path: str, series_key: list[str] | None = None) -> None:
    """Forecast table, laid out by series in files of bounded size.

    A lookup reads the row groups whose range and Bloom filter admit the series; the number of files depends on
    the rows, not on the series.
    """
    if not series_key:
        df.write.mode("overwrite").parquet(path)
        return
    laid = df.repartitionByRange(*series_key).sortWithinPartitions(*series_key)
    writer = laid.write.mode("overwrite").option("maxRecordsPerFile", FORECAST_FILE_ROWS).option(
        "parquet.block.size", FORECAST_GROUP_BYTES)
    for c in series_key:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)


# Values of one test; lists of so many reach the files' filters value by value.
_LISTED = 10


def _any_of(name: str, values: list) -> Column:
    """One of the values, as a balanced tree of short lists, all of which reach the files' filters."""
    known = [v for v in values if v is not None]
    tests = [F.col(name).isin(known[i:i + _LISTED]) for i in range(0, len(known), _LISTED)]
    if len(known) < len(values):
        tests.append(F.col(name).isNull())
    while len(tests) > 1:
        tests = [a | b for a, b in zip(tests[::2], tests[1::2])] + tests[len(tests) // 2 * 2:]
    return tests[0] if tests else F.lit(False)


def forecast_lookup(spark: SparkSession, path: str, **wanted) -> DataFrame:
    """Stored forecast rows of one series, or of the listed ones; unknown ones have no rows."""
    df = spark.read.parquet(path)
    for name, value in wanted.items():
        df = df.filter(_any_of(name, list(dict.fromkeys(value)) if isinstance(value, (list, tuple)) else [value]))
    return df
