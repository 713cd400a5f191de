"""Document files (text, JSON, PDF) as rows ``(content, source, metadata, error)``."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tallyloom.session import settle

# Known suffixes with the type each has in the metadata, the text that stands for a
# PDF when no extractor is given, and what the error of another suffix begins with.
SUFFIX_TYPES = {".txt": "text", ".pdf": "pdf", ".json": "json"}
PDF_PLACEHOLDER = "[PDF Content Placeholder] - "
UNKNOWN_SUFFIX = "Unsupported file format: "

# Speed only: a scan is joined to no fewer tasks a core, and no more than so many of Spark's go into one.
FEW_TASKS = 4
PACKS = 16
# Files that a task reads, about, and files and bytes that it hands on at once.
FILES_A_TASK, BATCH_FILES, BATCH_BYTES = 512, 256, 16 << 20


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-case suffix with its dot; empty for names without one."""
    return F.lower(F.regexp_extract(_name(path), r"^.+(\.[^.]+)$", 1))


def _metadata(path: Column, kind: Column) -> Column:
    return F.create_map(
        F.lit("filename"), _name(path), F.lit("type"), kind, F.lit("path"), path
    )


def _newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


_READ = T.StructType([
    T.StructField("content", T.StringType()), T.StructField("error", T.StringType()),
])


@F.pandas_udf(_READ)
def _print_json(texts: pd.Series) -> pd.DataFrame:
    """JSON printed again with indent 2; text that is no JSON gives an error."""
    content, errors = [], []
    for s in texts:
        try:
            content.append(None if s is None else json.dumps(json.loads(s), indent=2))
            errors.append(None)
        except ValueError as e:
            content.append(None)
            errors.append(f"{type(e).__name__}: {e}")
    return pd.DataFrame({"content": content, "error": errors}, dtype=object)


def _glob(suffixes: list[str]) -> str:
    """File name pattern of suffixes in any case."""
    parts = ["".join(f"[{c}{c.upper()}]" for c in s[1:]) for s in suffixes]
    return "*.{" + ",".join(parts) + "}"


def _in_fewer_tasks(df: DataFrame) -> DataFrame:
    """A scan of very many small files in tasks of more files each.

    Spark counts every file as 4 MB at least, which makes a task of 32; up to PACKS of these go into one.
    """
    packs = df.rdd.getNumPartitions()
    return df.coalesce(max(FEW_TASKS * df.sparkSession.sparkContext.defaultParallelism, -(-packs // PACKS)))


def _roots(spark: SparkSession, paths: list[str]) -> list[tuple[str, str]] | None:
    """Every path as Spark's readers print it and as an address; None if there is none, or pyarrow.fs cannot reach it."""
    out = []
    for p in paths:
        if re.search(r"[*?\[\]{}\\]", p):  # a pattern, for Spark to resolve
            return None
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(path):
            return None
        whole = store.makeQualified(path)
        uri = whole.toUri()
        address = uri.getPath() if uri.getScheme() == "file" else uri.toString()
        try:
            _opened(address)
        except (ValueError, OSError):
            return None
        out.append((whole.toString(), address))
    return list(dict.fromkeys(out))


def _opened(address: str) -> tuple[fs.FileSystem, str]:
    return (fs.LocalFileSystem(), address) if address.startswith("/") else fs.FileSystem.from_uri(address)


def _hidden(f: fs.FileInfo) -> bool:
    """Files and folders that Spark's readers leave out; empty files are among them."""
    name, folder = f.base_name, f.type == fs.FileType.Directory
    if folder and name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_") or (
        not folder and f.size == 0)


_LISTED = "path string, root string, address string, inside string, folder boolean"


def _listed(spark: SparkSession, roots: list[tuple[str, str]]) -> DataFrame:
    """Settled (path, root, address, inside) of all files below the roots, as Spark's recursive lookup finds them.

    Tasks list the folders, one level after the other; the driver gets the folders alone.
    """
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for root, address, inside in zip(*(b.column(i).to_pylist() for i in range(3))):
                store, base = _opened(address)
                at = base.rstrip("/") + inside
                info = store.get_file_info(at or "/")
                found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at or "/"))
                found = [(f, inside if f is info else f"{inside}/{f.base_name}") for f in found
                         if not _hidden(f)]
                for k in range(0, len(found), 10_000):
                    part = found[k:k + 10_000]
                    names = [n for _, n in part]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([root.rstrip("/") + n for n in names], pa.string()), pa.array([root] * len(part)),
                         pa.array([address] * len(part)), pa.array(names, pa.string()),
                         pa.array([f.type == fs.FileType.Directory for f, _ in part])],
                        names=["path", "root", "address", "inside", "folder"])

    levels, folders = [], [(root, address, "") for root, address in roots]
    while folders:
        tasks = min(len(folders), FEW_TASKS * spark.sparkContext.defaultParallelism)
        asked = spark.createDataFrame(folders, "root string, address string, inside string").repartition(tasks)
        level = settle(asked.mapInArrow(listed, _LISTED), "listed")
        levels.append(level.filter("NOT folder"))
        folders = [tuple(r) for r in level.filter("folder").select("root", "address", "inside").collect()]
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    names = [r.rstrip("/") + "/" for r, _ in roots]
    if any(a != b and a.startswith(b) for a in names for b in names):
        out = out.dropDuplicates(["path"])
    return out.drop("folder")


def _contents(listed: DataFrame) -> DataFrame:
    """Listed files as ``(path, content binary)``."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores: dict[str, tuple[fs.FileSystem, str]] = {}
        paths, blobs, size = [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(blobs, pa.binary())],
                                              ["path", "content"])

        for b in batches:
            for path, address, inside in zip(*(b.column(c).to_pylist() for c in ("path", "address", "inside"))):
                store, base = stores.setdefault(address, _opened(address))
                with store.open_input_stream(base.rstrip("/") + inside if inside else base, compression=None) as f:
                    blob = f.read()
                if blobs and size + len(blob) > BATCH_BYTES:
                    yield batch()
                    paths, blobs, size = [], [], 0
                paths.append(path)
                blobs.append(blob)
                size += len(blob)
                if len(blobs) >= BATCH_FILES:
                    yield batch()
                    paths, blobs, size = [], [], 0
        if blobs:
            yield batch()

    spark = listed.sparkSession
    tasks = max(FEW_TASKS * spark.sparkContext.defaultParallelism, -(-listed.count() // FILES_A_TASK))
    return listed.select("path", "address", "inside").repartition(tasks, "path").mapInArrow(
        read, "path string, content binary")


def _with_suffixes(listed: DataFrame, suffixes: list[str]) -> DataFrame:
    return listed.filter(F.lower(_name(F.col("path"))).rlike(
        "(" + "|".join(re.escape(s) for s in suffixes) + ")$"))


def scan_files(
    spark: SparkSession, paths: str | list[str], recursive: bool = False,
    suffixes: list[str] | None = None,
) -> DataFrame:
    """Files as ``(path, content binary)``; sub-folders only when ``recursive``.

    With suffixes only such files are read. Folders with all below them are listed by tasks, so that the driver holds
    no file's name; patterns, and stores that pyarrow.fs does not know, are left to Spark's reader.
    """
    roots = _roots(spark, [paths] if isinstance(paths, str) else paths) if recursive else None
    if roots:
        listed = _listed(spark, roots)
        return _contents(_with_suffixes(listed, suffixes) if suffixes else listed)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if suffixes:
        reader = reader.option("pathGlobFilter", _glob(suffixes))
    return _in_fewer_tasks(reader.load(paths).select("path", "content"))


def text_documents(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=recursive)
    p = F.col("_metadata.file_path")
    return _in_fewer_tasks(df.select(
        _newlines(F.col("value")).alias("content"), p.alias("source"),
        _metadata(p, F.lit("text")).alias("metadata"),
    ))


def json_documents(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    files = scan_files(spark, path, recursive, [".json"])
    return _documents(files.withColumn("_suffix", F.lit(".json")), None)


def pdf_documents(files: DataFrame, make_extractor=None) -> DataFrame:
    """Files ``(path, content)``, all taken as PDF, → documents."""
    return _documents(files.withColumn("_suffix", F.lit(".pdf")), make_extractor)


def _extractor_udf(make_extractor: Callable[[], Callable[[bytes], list[str]]]):
    @F.pandas_udf(_READ)
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pages = make_extractor()
        for blobs in batches:
            content, errors = [], []
            for blob in blobs:
                try:
                    content.append(
                        None if blob is None
                        else "\n".join(p or "" for p in pages(bytes(blob))).strip())
                    errors.append(None)
                except Exception as e:  # one broken file must not end the job
                    content.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"content": content, "error": errors}, dtype=object)

    return extract


def _documents(files: DataFrame, make_extractor) -> DataFrame:
    """``(path, content, _suffix)`` → documents in one projection over one scan.

    ``make_extractor`` runs once per task and returns ``pages(bytes) -> page texts``; pages
    are joined by line ends and stripped. Without one, a placeholder names the PDF file.
    Only the JSON and PDF bytes go to Python.
    """
    kind, path, raw = F.col("_suffix"), F.col("path"), F.col("content")
    nothing = F.lit(None).cast("string")
    text = raw.cast("string")
    valid = F.is_valid_utf8(text)
    df = files.withColumn("_json", _print_json(F.when(kind == ".json", text)))
    if make_extractor is None:
        pdf, pdf_error = F.concat(F.lit(PDF_PLACEHOLDER), _name(path)), nothing
    else:
        df = df.withColumn("_pdf", _extractor_udf(make_extractor)(F.when(kind == ".pdf", raw)))
        pdf, pdf_error = F.col("_pdf.content"), F.col("_pdf.error")
    types = F.create_map(*[F.lit(x) for pair in SUFFIX_TYPES.items() for x in pair])
    return df.select(
        F.when(kind == ".json", F.col("_json.content")).when(kind == ".pdf", pdf)
        .when((kind == ".txt") & valid, _newlines(text)).alias("content"),
        path.alias("source"),
        _metadata(path, F.coalesce(F.element_at(types, kind), F.lit("unknown"))).alias("metadata"),
        F.when(kind == ".json", F.col("_json.error")).when(kind == ".pdf", pdf_error)
        .when((kind == ".txt") & ~valid, F.lit("not valid utf-8"))
        .when(~kind.isin(list(SUFFIX_TYPES)),
              F.concat(F.lit(UNKNOWN_SUFFIX), kind)).alias("error"),
    )


def load_files(
    spark: SparkSession, paths: str | list[str], recursive: bool = False, make_extractor=None,
    only_known: bool = True,
) -> DataFrame:
    """Every file by its suffix; ``error`` is set where a file could not be read.

    Files of other types are left out when a folder is listed (``only_known``) and become
    error rows when they were asked for by name; of those only the path is read.
    """
    roots = _roots(spark, [paths] if isinstance(paths, str) else paths) if recursive else None
    listed = _listed(spark, roots) if roots else None
    files = _contents(_with_suffixes(listed, list(SUFFIX_TYPES))) if roots else scan_files(
        spark, paths, recursive, list(SUFFIX_TYPES))
    known = _documents(files.withColumn("_suffix", suffix(F.col("path"))), make_extractor)
    if only_known:
        return known
    other = (listed if roots else scan_files(spark, paths, recursive)).select(
        "path", suffix(F.col("path")).alias("_suffix"), F.lit(None).cast("binary").alias("content"))
    return known.unionByName(
        _documents(other.filter(~F.col("_suffix").isin(list(SUFFIX_TYPES))), None))


def good(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col("error").isNull()).drop("error")


def failed(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col("error").isNotNull()).select("source", "error")


def to_struct(documents: DataFrame) -> DataFrame:
    """Add ``document``, the struct (content, source, metadata)."""
    return documents.withColumn("document", F.struct("content", "source", "metadata"))


def from_table(df: DataFrame, content: str, source: str, metadata: dict[str, Column] | None = None):
    """Documents from any table with a text column."""
    entries = [x for k, v in (metadata or {}).items() for x in (F.lit(k), v.cast("string"))]
    meta = F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
    return df.select(
        F.col(content).alias("content"), F.col(source).alias("source"), meta.alias("metadata")
    )
