"""SentencePiece encoding and decoding by a table of distinct chunks."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from zlib import compress, crc32, decompress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyloom import session
from tallyloom.llm import pieces
from tallyloom.llm.common import arrow_schema, as_schema, field, map_texts, partitions, sha256_hex, sliced

# Bounds of a batch of documents: code points of text, and distinct chunks.
BATCH_CHARS = 24_000_000
BATCH_CHUNKS = 400_000
# Chunks encoded in one call.
ENCODE_CHUNKS = 20_000


class _Codes(dict):
    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        return n


def _pack(codes: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, so that the high zeros compress away."""
    return compress(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(
        np.frombuffer(decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _pack_chunks(chunks: list[str]) -> bytes:
    """Chunks hold no plain space: it became a marker."""
    return compress(" ".join([c[1:] for c in chunks]).encode(), 1)


def _unpack_chunks(data: bytes) -> list[str]:
    return [pieces.MARK + c for c in decompress(data).decode().split(" ")]


def _coded(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """Rows of two kinds per batch of documents: each document as numbers of its chunks (bucket
    null), and the batch's distinct chunks with their numbers, one row per bucket of the
    distinct-chunk table. Written once, so batches keep their numbers."""
    from pyspark import TaskContext

    schema = as_schema([("batch", "long"), field(docs, id_col), ("bucket", "int"),
                        ("codes", "binary"), ("chunks", "binary")])
    target = arrow_schema(schema)

    def dictionary(number: int, chunks: list[str]) -> pa.RecordBatch:
        own = np.fromiter((crc32(c.encode()) for c in chunks), np.uint32, len(chunks)) % buckets
        order = np.argsort(own, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(own[order])) + 1)
        n = len(parts)
        return pa.RecordBatch.from_arrays(
            [pa.array([number] * n, pa.int64()), pa.nulls(n, target.field(1).type),
             pa.array([int(own[p[0]]) for p in parts], pa.int32()),
             pa.array([_pack(np.diff(p, prepend=0)) for p in parts], pa.binary()),
             pa.array([_pack_chunks([chunks[i] for i in p.tolist()]) for p in parts], pa.binary())],
            schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        codes, chars = _Codes(), 0
        for b in sliced(batches):
            ids, texts = b.column(0).cast(target.field(1).type), b.column(1)
            start, packed = 0, []
            for i, t in enumerate(texts):
                t = t.as_py() or ""
                got = pieces.chunks(t)
                packed.append(_pack(np.fromiter(map(codes.__getitem__, got), np.uint32, len(got))))
                chars += len(t)
                full = chars >= BATCH_CHARS or len(codes) >= BATCH_CHUNKS
                if full or i + 1 == len(texts):
                    n = i + 1 - start
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number] * n, pa.int64()), ids.slice(start, n),
                         pa.nulls(n, pa.int32()), pa.array(packed, pa.binary()),
                         pa.nulls(n, pa.binary())], schema=target)
                    start, packed = i + 1, []
                if full:
                    if codes:
                        yield dictionary(number, list(codes))
                    number, codes, chars = number + 1, _Codes(), 0
        if codes:
            yield dictionary(number, list(codes))

    rows = docs.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(run, schema)
    return _bucketed(rows, buckets, "batch")


def _bucketed(rows: DataFrame, n: int, by: str) -> DataFrame:
    """``rows`` written to the shared folder in buckets, so that a later join by ``by`` need not
    move them again. Buckets take a table of the catalog; a ``session.scratch`` drops it."""
    spark = rows.sparkSession
    path = session.scratch_path(spark, "coded")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    session.note(path, table=name)
    rows.write.bucketBy(n, by).option("path", path).saveAsTable(name)
    return spark.table(name)


def _segmented(dictionaries: DataFrame, model, buckets: int) -> DataFrame:
    """(batch, codes, lengths, ids) of the batches' chunks.

    The rows of a bucket meet in one task, which holds this part of the distinct-chunk table and
    segments each of its chunks once.
    """
    back = as_schema([("batch", "long"), ("codes", "binary"), ("lengths", "binary"), ("ids", "binary")])
    target = arrow_schema(back)

    def segment(batches):
        encode = pieces.chunks_encoder(pieces.load(model.value))
        table: dict[str, bytes] = {}
        bucket = None
        for b in batches:
            for i in range(b.num_rows):
                which, number, codes, packed = (c[i].as_py() for c in b.columns)
                if which != bucket:
                    table, bucket = {}, which
                chunks = _unpack_chunks(packed)
                new = [c for c in chunks if c not in table]
                for start in range(0, len(new), ENCODE_CHUNKS):
                    some = new[start:start + ENCODE_CHUNKS]
                    table.update(zip(some, (array("I", x).tobytes() for x in encode(some))))
                found = [table[c] for c in chunks]
                lengths = [len(x) // 4 for x in found]
                ids = np.frombuffer(b"".join(found), np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([codes], pa.binary()),
                     pa.array([_pack(np.array(lengths, np.uint32))], pa.binary()),
                     pa.array([_pack(ids)], pa.binary())], schema=target)

    return (dictionaries.select("bucket", "batch", "codes", "chunks")
            .repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(segment, back))


def _positions(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, ids) by code, of a batch's chunks from all buckets."""
    if not parts:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty.astype(np.int32)
    codes = np.concatenate([np.cumsum(p[0]) for p in parts])
    lengths, ids = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
    lengths = lengths.astype(np.int64)
    start, length = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
    start[codes] = np.cumsum(lengths) - lengths
    length[codes] = lengths
    return start, length, ids.astype(np.int32)


def _lookup(table: tuple, codes: np.ndarray) -> np.ndarray:
    """Ids of the chunks with these codes, one after the other."""
    start, length, ids = table
    n = length[codes]
    before = np.cumsum(n) - n
    return ids[np.arange(int(n.sum())) + np.repeat(start[codes] - before, n)]


def encode(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, ids) of every whole text, as the library encodes it without begin or end ids.

    Texts become positions in a dictionary of their batch's distinct chunks; the dictionaries
    are merged into buckets, each distinct chunk is segmented once, and the ids are joined back
    by position. Only dictionaries and their ids are shuffled; the coded texts are written in
    buckets by batch and stay there. A model whose pieces cross whitespace is applied to whole texts instead.

    Null and empty texts give no ids. Null ids, repeated rows and very long texts are kept, one
    row out per row in. Further columns are not read.
    """
    model = pieces.model_bytes(model_path)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # one model file
    if not pieces.splits_at_markers(pieces.load(model)):
        def make():
            sp = pieces.load(shipped.value)
            return lambda t: (sp.encode(t),)
        return map_texts(docs, text_col, [id_col], make, [("ids", "array<int>")])

    buckets = partitions(docs)
    coded = _coded(docs, id_col, text_col, buckets)
    tables = _segmented(coded.filter("bucket IS NOT NULL"), shipped, buckets)
    schema = as_schema([field(docs, id_col), ("ids", "array<int>")])
    target = arrow_schema(schema)

    def join(own: pa.Table, segmented: pa.Table) -> pa.Table:
        parts = [tuple(map(_unpack, x)) for x in zip(*(c.to_pylist() for c in segmented.columns[1:]))]
        table = _positions(parts)
        lists = [_lookup(table, _unpack(x.as_py())) for x in own.column(2)]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
        values = np.concatenate(lists) if lists else np.zeros(0, np.int32)
        return pa.Table.from_arrays(
            [own.column(1).cast(target.field(0).type),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)).cast(target.field(1).type)],
            schema=target)

    texts = coded.filter("bucket IS NULL").select("batch", f"`{id_col}`", "codes")
    return texts.groupBy("batch").cogroup(tables.groupBy("batch")).applyInArrow(join, schema)


def _lists(column: pa.Array) -> Iterator[list[int] | None]:
    """Lists of an Arrow column one at a time: as Python integers they take much memory."""
    for x in column:
        yield None if not x.is_valid else x.values.to_numpy(zero_copy_only=False).tolist()


def decode(
    rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids",
    text_col: str = "text",
) -> DataFrame:
    """(id, ids, text): the library's text of each list of ids; null lists give null texts.

    Empty lists give empty texts, a list of any length is one row of one task, an id that the model does not know
    ends the job. Null ids and repeated rows come out as they came in, an empty table gives none. Further
    columns are not read.
    """
    shipped = rows.sparkSession.sparkContext.broadcast(pieces.model_bytes(model_path))
    schema = as_schema([field(rows, id_col), field(rows, ids_col), (text_col, "string")])
    target = arrow_schema(schema)

    def run(batches):
        sp = pieces.load(shipped.value)
        for b in sliced(batches):
            lists = b.column(1).cast(target.field(1).type)
            texts = [None if x is None else sp.decode(x) for x in _lists(lists)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(target.field(0).type), lists, pa.array(texts, pa.string())],
                schema=target)

    return rows.select(f"`{id_col}`", f"`{ids_col}`").mapInArrow(run, schema)


def digests(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): hex digests of the ids, as decimals with commas
    between, and of the text that ``decode`` gives; null lists as empty ones.

    A list of any length is one row of one task. Null ids and repeated rows come out as they came in, an empty
    table gives none. Further columns are not read.
    """
    shipped = rows.sparkSession.sparkContext.broadcast(pieces.model_bytes(model_path))
    schema = as_schema([field(rows, id_col), ("n_tokens", "long"), ("ids_sha256", "string"),
                        ("decoded_sha256", "string")])
    target = arrow_schema(schema)

    def run(batches):
        sp, decimal = pieces.load(shipped.value), _Decimals()
        for b in sliced(batches):
            n, of_ids, of_text = [], [], []
            for x in _lists(b.column(1)):
                x = x or []
                n.append(len(x))
                of_ids.append(sha256_hex(b",".join(map(decimal.__getitem__, x))))
                of_text.append(sha256_hex(sp.decode(x)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(target.field(0).type), pa.array(n, pa.int64()),
                 pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], schema=target)

    return rows.select(f"`{id_col}`", f"`{ids_col}`").mapInArrow(run, schema)


class _Decimals(dict):
    def __missing__(self, number: int) -> bytes:
        text = self[number] = b"%d" % number
        return text
