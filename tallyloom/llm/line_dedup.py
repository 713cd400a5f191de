"""Line dedup over range-partitioned line hashes.

Every line long enough becomes a row of its key's 128-bit hash, its document and its position. The
rows are range-partitioned and sorted by hash, document and position; each task streams its sorted
rows, the first document of a hash keeps its lines, and what the others lose comes back as one
compressed bitmap per document, so texts take no part until the bitmaps are applied.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tallyloom import session
from tallyloom.llm.common import arrow_schema, as_schema, partitions, sliced

MIN_CHARS = 20
MIN_DOCS = 3

# What the streamed rows say: dropped for sure, to be judged with the neighbours, a hash at a task's edge.
_DROPPED, _OPEN, _EDGE = 0, 1, 2
_SPACE = " \t\n\x0b\x0c\r"

OUTPUT = ("text_key", "n_lines", "n_dropped", "keep")


def _text(text_col: str):
    return F.coalesce(F.col(f"`{text_col}`"), F.lit(""))


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(hi, lo, id, key, pos): a row per line whose key has ``min_chars`` code points.

    Besides, a row per document without a hash, whose ``pos`` is its number of lines. ``key`` hashes the
    text and tells rows of one id apart.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = as_schema([("hi", "long"), ("lo", "long"), ("id", id_type), ("key", "long"), ("pos", "int")])
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            split = pc.split_pattern(b.column(2).cast(pa.large_string()), "\n")
            counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = pc.ascii_lower(pc.ascii_trim(split.flatten(), characters=_SPACE))
            ends = np.cumsum(counts)
            long = np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), min_chars).to_numpy(zero_copy_only=False))
            hashes = np.frombuffer(b"".join(
                map(xxhash.xxh3_128_digest, keys.take(pa.array(long)).cast(pa.large_binary()).to_pylist())),
                np.int64).reshape(-1, 2)
            rows = np.searchsorted(ends, long, side="right")
            nothing = pa.nulls(len(counts), pa.int64())
            doc = pa.array(np.concatenate([rows, np.arange(len(counts))]))
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array(hashes[:, 0]), nothing]),
                 pa.concat_arrays([pa.array(hashes[:, 1]), nothing]),
                 b.column(0).cast(target.field(2).type).take(doc), b.column(1).take(doc),
                 pa.array(np.concatenate([long - (ends - counts)[rows], counts]).astype(np.int32))],
                schema=target)

    text = _text(text_col)
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("key"), text.alias("text")) \
        .mapInArrow(run, schema)


def _differs(a: pa.Array) -> np.ndarray:
    """Whether a value differs from the one before it, nulls alike; the first does."""
    if len(a) < 2:
        return np.ones(len(a), bool)
    now, then = a.slice(1), a.slice(0, len(a) - 1)
    either = pc.xor(now.is_null(), then.is_null())
    return np.concatenate([[True], pc.or_(
        either, pc.fill_null(pc.not_equal(now, then), False)).to_numpy(zero_copy_only=False)])


def _stream(rows: DataFrame, min_docs: int) -> DataFrame:
    """Sorted rows → what is dropped, what the edges leave open, and the hashes at the edges.

    Only a task's first hash may have begun in the task before, and only its last may go on in the
    next one. Rows of the first are left open; of the last they are if it has too few documents here.
    A task holds one Arrow batch, and of the hash at its end the rows of the documents between the
    first and the ``min_docs``-th.
    """
    id_type = rows.schema["id"].dataType.simpleString()
    schema = as_schema([("kind", "int"), ("hi", "long"), ("lo", "long"), ("id", id_type), ("last", id_type),
                        ("key", "long"), ("pos", "int"), ("n_docs", "long"), ("part", "int")])
    target = arrow_schema(schema)

    def out(kind, hi, lo, ids, last, key, pos, n_docs):
        n = len(ids)
        part = TaskContext.get().partitionId()
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int32)), hi, lo, ids,
             pa.nulls(n, target.field(4).type) if last is None else last, key, pos,
             pa.nulls(n, pa.int64()) if n_docs is None else n_docs, pa.array(np.full(n, part, np.int32))],
            schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True           # the hash at hand is the task's first
        hash_ = None           # the hash at hand
        top = last = None      # its first and its latest document
        n = 0                  # its documents so far
        pending: list = []     # its rows that are dropped once there are enough documents

        def edge():
            one = lambda v, t: pa.array([v], t)
            return out(_EDGE, one(hash_[0], pa.int64()), one(hash_[1], pa.int64()),
                       one(top, target.field(3).type), one(last, target.field(4).type),
                       pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), one(n, pa.int64()))

        for b in batches:
            if not b.num_rows:
                continue
            hi, lo, ids, key, pos = b.columns
            ids = ids.cast(target.field(3).type)
            new_hash = _differs(hi) | _differs(lo)
            new_doc = new_hash | _differs(ids)
            goes_on = (hi[0].as_py(), lo[0].as_py()) == hash_
            if goes_on:
                new_hash[0] = False
                new_doc[0] = ids[0].as_py() != last
            # number of a row's document within its hash, from 1
            docs = np.cumsum(new_doc)
            starts = np.flatnonzero(new_hash)
            group = np.cumsum(new_hash)  # 0: the hash at hand
            base = np.concatenate([[-n if goes_on else 0], docs[starts] - 1])
            nth = docs - base[group]
            total = np.maximum.reduceat(nth, np.concatenate([[0], starts]) if goes_on else starts)
            size = np.concatenate([total if goes_on else np.concatenate([[0], total])])
            enough = size[group] >= min_docs
            last_group = group == group[-1]

            if len(starts) and hash_ is not None:  # the hash at hand ends
                ended = int(size[0]) if goes_on else n
                if goes_on and starts[0] > 0:
                    last = ids[int(starts[0]) - 1].as_py()
                n = ended
                if first:
                    yield edge()
                elif n >= min_docs:
                    yield from pending
                pending = []
            elif goes_on and not first and size[0] >= min_docs:
                yield from pending
                pending = []

            still_first = first & (group == (0 if hash_ is not None else 1))
            open_ = np.flatnonzero(still_first)
            if len(open_):
                at = pa.array(open_)
                yield out(_OPEN, hi.take(at), lo.take(at), ids.take(at), None, key.take(at), pos.take(at), None)
            drop = np.flatnonzero(enough & (nth > 1) & ~still_first)
            if len(drop):
                at = pa.array(drop)
                yield out(_DROPPED, hi.take(at), lo.take(at), ids.take(at), None, key.take(at), pos.take(at), None)
            wait = np.flatnonzero(last_group & ~enough & (nth > 1) & ~still_first)
            if len(wait):
                at = pa.array(wait)
                pending.append(out(_DROPPED, hi.take(at), lo.take(at), ids.take(at), None,
                                   key.take(at), pos.take(at), None))

            if len(starts):
                if hash_ is not None or len(starts) > 1:
                    if first and hash_ is None:  # the first hash began and ended in this batch
                        hash_, top, n = (hi[0].as_py(), lo[0].as_py()), ids[0].as_py(), int(size[1])
                        last = ids[int(starts[1]) - 1].as_py()
                        yield edge()
                    first = False
                top = ids[int(starts[-1])].as_py()
            hash_, last, n = (hi[-1].as_py(), lo[-1].as_py()), ids[-1].as_py(), int(size[-1])
        if hash_ is not None:
            if not first:
                for p in pending:  # too few documents here
                    arrays = list(p.columns)
                    arrays[0] = pa.array(np.full(p.num_rows, _OPEN, np.int32))
                    yield pa.RecordBatch.from_arrays(arrays, schema=target)
            yield edge()

    return rows.select("hi", "lo", "id", "key", "pos").mapInArrow(run, schema)


def keep_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """(id, text_key, n_lines, n_dropped, keep): which lines of a document stay.

    A line's key is the line without ASCII white space at its ends, A-Z lowered. A key of at least
    ``min_chars`` code points in at least ``min_docs`` documents is dropped everywhere but in the document
    with the largest id. ``keep`` holds a bit per line, first line first, packed and compressed by zlib;
    ``text_key`` is ``xxhash64`` of the text.

    Null and empty texts are one empty line, which stays. Long texts are split whole. Rows with one id, null
    too, are one document: together they count once and lose or keep a key alike; a null id is the
    smallest. Rows alike in id and text share one bitmap. No rows give no bitmaps. Further columns are
    not read; an id column may not have the name of an output column. Keys are compared by
    128-bit hashes. A key in very many documents lies in many ranges: the tasks on both sides of a cut hand
    in two rows each, and a join with those rows judges what the cut left open.
    """
    if id_col in OUTPUT:
        raise ValueError(f"the id column may not be called {id_col}")
    lines = session.settle(line_hashes(docs, id_col, text_col, min_chars), "lines")
    order = ["hi", "lo", F.desc_nulls_last("id"), "key", "pos"]
    ranged = lines.filter("hi IS NOT NULL").repartitionByRange(partitions(docs), *order).sortWithinPartitions(*order)
    said = session.settle(_stream(ranged, min_docs), "line-verdicts")

    over = Window.partitionBy("hi", "lo").orderBy("part")
    cut = (F.row_number().over(over) > 1) & F.lag("last").over(over).eqNullSafe(F.col("id"))
    edges = said.filter(F.col("kind") == _EDGE).select("hi", "lo", "part", "id", (
        F.col("n_docs") - cut.cast("long")).alias("n_docs"))
    edges = session.settle(edges.groupBy("hi", "lo").agg(
        F.sum("n_docs").alias("n_docs"), F.min_by("id", "part").alias("top")), "edges")
    judged = said.filter(F.col("kind") == _OPEN).join(edges.filter(F.col("n_docs") >= min_docs).drop("n_docs"), ["hi", "lo"])
    dropped = said.filter(F.col("kind") == _DROPPED).select("id", "key", "pos").union(
        judged.filter(~F.col("id").eqNullSafe(F.col("top"))).select("id", "key", "pos"))

    per_doc = dropped.withColumn("n", F.lit(None).cast("int")).union(
        lines.filter("hi IS NULL").select("id", "key", F.lit(None).cast("int"), "pos")) \
        .groupBy("id", "key").agg(F.max("n").alias("n"), F.collect_set("pos").alias("gone"))
    schema = as_schema([("id", docs.schema[id_col].dataType.simpleString()), ("text_key", "long"),
                        ("n_lines", "long"), ("n_dropped", "long"), ("keep", "binary")])
    target = arrow_schema(schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            gone = b.column(3).to_pylist()
            for n, g in zip(b.column(2).to_pylist(), gone):
                mask = np.ones(n, bool)
                mask[g] = False
                keep.append(zlib.compress(np.packbits(mask).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(target.field(0).type), b.column(1), b.column(2).cast(pa.int64()),
                 pa.array([len(g) for g in gone], pa.int64()), pa.array(keep, pa.binary())], schema=target)

    return per_doc.mapInArrow(pack, schema).withColumnRenamed("id", id_col)


def unpacked(keep: bytes, n_lines: int) -> np.ndarray:
    """Mask of the lines that stay."""
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines).astype(bool)


def apply_bitmaps(
    docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_lines, n_dropped, text): every document's lines that its bitmap keeps, joined by \\n.

    One row per row of ``docs``; null texts stay null, further columns are not read. Documents and
    bitmaps meet by id and text hash.
    """
    type_ = docs.schema[id_col].dataType.simpleString()
    schema = as_schema([("id", type_), ("n_lines", "long"), ("n_dropped", "long"), ("text", "string")])
    target = arrow_schema(schema)
    text = F.col(f"`{text_col}`")
    left = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(_text(text_col)).alias("key"), text.alias("text"))
    right = bitmaps.select(F.col(f"`{id_col}`").alias("id_"), F.col("text_key").alias("key_"), "n_lines", "n_dropped",
                           F.when(F.col("n_dropped") > 0, F.col("keep")).alias("keep"))
    joined = left.join(right, F.col("id").eqNullSafe(F.col("id_")) & (F.col("key") == F.col("key_")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = []
            for text, n, keep in zip(*(b.column(i).to_pylist() for i in (3, 1, 4))):
                if keep is not None and text is not None:
                    text = "\n".join(compress(text.split("\n"), unpacked(keep, n)))
                texts.append(text)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(target.field(0).type), b.column(1), b.column(2), pa.array(texts, pa.string())],
                schema=target)

    return joined.select("id", "n_lines", "n_dropped", "text", "keep").mapInArrow(cut, schema) \
        .withColumnRenamed("id", id_col)
