"""Corpus pipeline over ``documents``: stages that each apply one operator to what is left.

All stages take null ids, repeated rows, very long texts (a text is one row of one task) and empty tables, and need
the columns of ``documents``; further ones pass through all but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom import session
from tallyloom.llm import decontaminate, jaccard_join, quality, secret_scan, sp_codec

PIECE_MODEL = "piece_bpe_32k.model"

# The last stage's pieces cannot be stated in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars``, which the documents must have, brought up to date with the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their failing lines.

    Null, empty and short texts go; rows alike are judged each for itself.
    """
    return _counted(quality.cleaned(docs))


def jaccard_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: the one with the smallest id.

    Unlike texts under one id all stay, a null id is the largest, and rows alike in id and text are one.
    """
    return jaccard_join.first_of_groups(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark spans cut out; documents that are mostly benchmark removed.

    Null and empty texts stay as they are; rows alike stay alike.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _counted(decontaminate.decontaminated(docs, benchmark))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced by their kind; all rows stay, null and empty texts as they are."""
    return _counted(secret_scan.redacted(docs))


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, text): the ids of each document and the text they decode to; null texts are empty ones."""
    path = public_tokenizers.path(PIECE_MODEL)
    return sp_codec.decode(sp_codec.encode(docs, path), path)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("SentencePiece encoding and decoding", sentencepiece_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = session.settle(docs, f"stage-{i}")
    return docs
