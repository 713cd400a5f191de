"""Helpers of the operators: Arrow maps over texts, digests, model files, blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyloom import session
from tallyloom.sources import commits


def sha256_hex(text: str | bytes) -> str:
    """Lower-case hex SHA-256 of a text's UTF-8 bytes."""
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def field(df: DataFrame, name: str) -> T.StructField:
    """Field of ``df`` by its exact name."""
    return next(f for f in df.schema.fields if f.name == name)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    return to_arrow_schema(schema, prefers_large_types=False)


def as_schema(fields: list) -> T.StructType:
    """Struct type of fields, given as StructField or as (name, type text)."""
    out = []
    for f in fields:
        if not isinstance(f, T.StructField):
            f = T.StructField(f[0], T._parse_datatype_string(f[1]), True)
        out.append(T.StructField(f.name, f.dataType, True))
    return T.StructType(out)


# Rows that a worker turns into Python objects at a time.
SLICE_ROWS = 1_000


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches: texts as Python objects take several times their bytes."""
    for b in batches:
        for start in range(0, b.num_rows, SLICE_ROWS):
            yield b.slice(start, SLICE_ROWS)


def map_texts(
    df: DataFrame, text_col: str, keep: list[str], make: Callable, fields: list
) -> DataFrame:
    """Columns ``keep`` as they are plus ``fields``, worked out from the text.

    ``make()`` runs once per task and returns a function from one whole text (null is the
    empty text) to a tuple with one value per field. Only the named columns are read.
    """
    schema = as_schema([field(df, k) for k in keep] + list(fields))
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in sliced(batches):
            rows = [work(t or "") for t in b.column(len(keep)).to_pylist()]
            made = list(zip(*rows)) if rows else [()] * len(fields)
            arrays = [b.column(i).cast(target.field(i).type) for i in range(len(keep))]
            arrays += [pa.array(c, target.field(len(keep) + i).type) for i, c in enumerate(made)]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.select(*[f"`{k}`" for k in keep], f"`{text_col}`").mapInArrow(run, schema)


def partitions(df: DataFrame) -> int:
    """Shuffle partitions the session asks for."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


# Bytes of rows that a task holds while blocks pass by.
HELD_BYTES = 64_000_000


class Blocks:
    """A side table in blocks of bounded size in the shared folder, read one after the other by the tasks.

    Neither the driver nor a task holds more than one. A table that fits one block is read once per task.
    """

    def __init__(self, folders: list[str], columns: list[str]):
        self.folders, self.columns = folders, columns

    def past(self, batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        """The rows that all blocks are to see before the next ones: about HELD_BYTES, in slices of SLICE_ROWS
        rows; if there is one block only, one slice at a time."""
        out, size = [], 0
        for b in sliced(batches):
            out.append(b)
            size += b.nbytes
            if size >= HELD_BYTES or len(self.folders) == 1:
                yield out
                out, size = [], 0
        if out:
            yield out

    def each(self, make: Callable[[pa.Table], object], kept: dict):
        """``make`` of every block in turn; ``kept``, the task's own, spares a single block the next reading."""
        for folder in self.folders:
            if folder in kept:
                yield kept[folder]
                continue
            store, base = fs.FileSystem.from_uri(folder)
            made = make(ds.dataset(base, filesystem=store, format="parquet").to_table(self.columns))
            if len(self.folders) == 1:
                kept[folder] = made
            yield made


def blocks(df: DataFrame, columns: list[str], rows: int) -> Blocks:
    """``df`` written as blocks of about ``rows`` rows each; at least one, which may be empty."""
    spark = df.sparkSession
    path = session.scratch_path(spark, "blocks")
    session.note(path)
    try:
        fs.FileSystem.from_uri(path)
    except (ValueError, OSError) as e:
        raise ValueError(f"the tasks cannot read {path}: pyarrow.fs does not know the folder") from e
    df.select(*columns).write.parquet(f"{path}/whole")
    whole = spark.read.parquet(f"{path}/whole")
    n = -(-whole.count() // rows)
    if n <= 1:
        return Blocks([f"{path}/whole"], columns)
    whole.withColumn("_block", F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")) \
        .repartition(n, "_block").write.partitionBy("_block").parquet(f"{path}/parts")
    return Blocks([f"{path}/parts/{name}" for name, _ in commits.names(spark, f"{path}/parts")
                   if name.startswith("_block=")], columns)
