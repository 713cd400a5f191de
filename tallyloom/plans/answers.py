"""Question answering over a document table or folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.operators import rag, requests, retrieval
from tallyloom.sources import documents


def index_folder(spark: SparkSession, folder: str, recursive: bool = False, make_extractor=None):
    """Index all readable files of a folder, numbered by path; an empty folder is an error."""
    docs = documents.good(documents.load_files(spark, folder, recursive, make_extractor))
    return retrieval.build_index(retrieval.number_documents(docs, ["source"]))


def ask_job(index: retrieval.Index, asked: DataFrame) -> DataFrame:
    """Answer the accepted rows of ``asked (query_id, query[, num_retrieval, max_tokens])``."""
    ok = requests.accepted(requests.split_ask(asked)).select(
        "query_id", "query", "num_retrieval", "max_tokens")
    most = requests.ASK_RANGES["num_retrieval"][1]
    return rag.answer(index, ok, most, "max_tokens").select(
        "query_id", "query", "retrieved_documents", "answer", "num_retrieved")


def answers_with(index: retrieval.Index, queries: DataFrame, make_client, k: int = 5,
                 max_tokens: int = 500, temperature: float = 0.7) -> DataFrame:
    """Search and prompt, then a plug-in generator instead of the echo."""
    results = retrieval.search(index, queries, k)
    prompts = rag.build_prompts(results, queries)
    return rag.generate(prompts, make_client, max_tokens, temperature).select(
        "query_id", "query", "answer", "error", F.col("num_retrieved"))
