"""Target-distribution importance resampling over hashed n-gram buckets.

A text's separators are collapsed to single spaces; an overlapped scan with boundary lookarounds then emits,
at the start of every word, the spans of the runs of 1 to 3 words there, and the CRC of a span's bytes names its
bucket. Bucket
counts of the documents and of the target texts give each bucket a gain, a document weighs the sum
of its gains, and seeded Gumbel noise turns the largest scores into a draw without replacement.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tallyloom import session
from tallyloom.llm.common import arrow_schema, as_schema, sliced
from tallyloom.operators import ordered

LONGEST = 3
BUCKETS = 10_000
PERCENT = 5
MIN_WORDS = 20
SEED = 42
# Relative accuracy of the quantile that spares most rows the ordering.
ACCURACY = 10_000

# Bytes of words stay (A-Z lowered); every other one becomes a space.
_CLEAN = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256))
# From the start of a word to the end of one: group LONGEST is the word, each group around it has one word more
# as far as the cleaned text goes.
_RUNS = rb"(?<![^ ])" + rb"(" * LONGEST + rb"[^ ]+)" + rb"(?: [^ ]+)?)" * (LONGEST - 1) + rb"(?![^ ])"

OUTPUT = ("n_words", "n_features", "weight", "score", "rank")


def cleaned(text: str) -> bytes:
    """Lower-cased words joined by one space."""
    return b" ".join(text.encode().translate(_CLEAN).split())


def scanner(buckets: int = BUCKETS):
    """Function from a text to (number of words, bucket of each feature)."""
    runs = regex.compile(_RUNS)
    spans = itemgetter(*range(LONGEST, 0, -1))

    def scan(text: str) -> tuple[int, np.ndarray]:
        matches = runs.finditer(cleaned(text), overlapped=True)
        codes = np.fromiter(map(crc32, chain.from_iterable(map(spans, matches))), np.uint32).reshape(-1, LONGEST)
        n = len(codes)
        # the last words have no run as long as asked
        found = [codes[:max(0, n - k), k] for k in range(LONGEST)]
        return n, np.concatenate(found) % np.uint32(buckets)

    return scan


def coded(docs: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS) -> DataFrame:
    """(_id, _key, _words, _codes): the buckets of a text's features as little-endian 32-bit numbers,
    16-bit ones if they fit; ``_key`` hashes the text and tells rows of one id apart."""
    schema = as_schema([("_id", docs.schema[id_col].dataType.simpleString()), ("_key", "long"),
                        ("_words", "long"), ("_codes", "binary")])
    target, kind = arrow_schema(schema), _kind(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(buckets)
        for b in sliced(batches):
            words, codes = [], []
            for text in b.column(2).to_pylist():
                n, found = scan(text or "")
                words.append(n)
                codes.append(found.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(target.field(0).type), b.column(1), pa.array(words, pa.int64()),
                 pa.array(codes, pa.binary())], schema=target)

    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(text).alias("_key"), text.alias("_text")) \
        .mapInArrow(run, schema)


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def bucket_counts(codes: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows of ``coded``.

    Each task adds up its own rows and hands on one number per bucket; the driver gets ``buckets`` numbers.
    """
    schema, kind = as_schema([("bucket", "int"), ("n", "long")]), _kind(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for codes in b.column(0).to_pylist():
                total += np.bincount(np.frombuffer(codes, kind), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], schema=arrow_schema(schema))

    out = np.zeros(buckets, np.int64)
    for bucket, n in codes.select("_codes").mapInArrow(run, schema).groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 · ln of the smoothed ratio of a bucket's shares in the target and in the source)."""
    buckets = len(source)
    s_all, t_all = float(source.sum() + buckets), float(target.sum() + buckets)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all)))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def _weighed(codes: DataFrame, gains: np.ndarray) -> DataFrame:
    fields = [f for f in codes.schema.fields if f.name != "_codes"]
    schema = as_schema([*fields, ("n_features", "long"), ("weight", "long")])
    target, kind = arrow_schema(schema), _kind(len(gains))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.frombuffer(c, kind) for c in b.column(len(fields)).to_pylist()]
            arrays = [b.column(i).cast(target.field(i).type) for i in range(len(fields))]
            arrays.append(pa.array([len(f) for f in found], pa.int64()))
            arrays.append(pa.array([int(gains[f].sum()) for f in found], pa.int64()))
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return codes.select(*[f.name for f in fields], "_codes").mapInArrow(run, schema)


def _noise(seed: int):
    """Gumbel noise in thousandths, drawn from the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _resampled(
    docs: DataFrame, target: DataFrame, id_col: str, text_col: str, target_text_col: str,
    percent: int, min_words: int, buckets: int, seed: int,
) -> DataFrame:
    """(_id, _key, _words, n_features, weight, score, rank)"""
    codes = session.settle(coded(docs, id_col, text_col, buckets), "features")
    goal = target.select(F.lit(0).alias("_id"), F.col(f"`{target_text_col}`").alias("_text"))
    gains = bucket_gains(bucket_counts(codes, buckets),
                         bucket_counts(coded(goal, "_id", "_text", buckets), buckets))
    scored = session.settle(
        _weighed(codes, gains).withColumn("score", F.col("weight") + _noise(seed)), "scores")

    # no more than the draw and a sliver below it has to be put in order
    asked = F.col("_words") >= min_words
    below = max(0.0, 1 - percent / 100 - 2 / ACCURACY)
    n, cut = scored.filter(asked).agg(F.count("*"), F.percentile_approx("score", below, ACCURACY)).first()
    drawn = percent * n // 100
    if drawn == 0:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    upper = asked & (F.col("score") >= cut)
    if scored.filter(upper).count() < drawn:
        upper = asked
    order = [F.desc("score"), F.asc_nulls_last("_id"), F.desc("weight"), F.desc("n_features"), F.asc("_key")]
    ranked = ordered.positions(scored.filter(upper), [], order)
    ranked = ranked.withColumn("rank", F.when(F.col("_pos") < drawn, F.col("_pos") + 1)).drop("_pos")
    return ranked.unionByName(scored.filter(~upper).withColumn("rank", F.lit(None).cast("long")))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    target_text_col: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS,
    buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank), one row per document.

    ``rank`` counts the drawn documents from 1: of the N documents with at least ``min_words`` words the
    floor(percent · N / 100) with the highest scores, ties to the smaller id; null for all others.

    Null and empty texts have no features and weight 0; they count neither for N nor for the draw.
    Texts are scanned whole, however long; their buckets are written once, two bytes a feature. A null id
    takes the noise of the empty text and loses ties. Repeated rows each count and may each be drawn;
    they draw the same noise. An empty target makes every weight a matter of the documents' own
    buckets; without documents there are no rows. Other columns are not read; an id column may not
    have the name of an output column.
    """
    if id_col in OUTPUT:
        raise ValueError(f"the id column may not be called {id_col}")
    out = _resampled(docs, target, id_col, text_col, target_text_col, percent, min_words, buckets, seed)
    return out.select(F.col("_id").alias(id_col), F.col("_words").alias("n_words"),
                      "n_features", "weight", "score", "rank")


def drawn(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    target_text_col: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS,
    buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """The drawn documents with all their columns, as they are.

    Rows alike in id and text stay together: all are returned if one of them is drawn. Odd input
    as in ``resample``; the id column may have any name.
    """
    got = _resampled(docs, target, id_col, text_col, target_text_col, percent, min_words, buckets, seed)
    got = got.filter("rank IS NOT NULL").select(
        F.col("_id").alias("_drawn_id"), F.col("_key").alias("_drawn_key")).distinct()
    return docs.join(
        got, F.col(f"`{id_col}`").eqNullSafe(F.col("_drawn_id"))
        & (F.xxhash64(F.col(f"`{text_col}`")) == F.col("_drawn_key")), "left_semi")
