"""Prompts from ranked documents, and answers from a plug-in generator."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.operators import retrieval

# Texts of the prompt and of the echo answer.
PROMPT_HEAD = "You are a helpful supply chain assistant. Use the following context to answer the question."
BLOCK_SEPARATOR = "\n---\n"
ECHO_HEAD = "[LocalLLM Response]\n"


def context_block(source: Column, content: Column) -> Column:
    return F.concat(
        F.lit("Source: "), F.coalesce(source, F.lit("Unknown")), F.lit("\n"),
        F.coalesce(content, F.lit("")),
    )


def prompt_text(context: Column, query: Column) -> Column:
    return F.concat(
        F.lit(PROMPT_HEAD + "\n\nCONTEXT:\n"), context,
        F.lit("\n\nQUESTION: "), query, F.lit("\n\nANSWER:"),
    )


def build_prompts(results: DataFrame, queries: DataFrame, with_documents: bool = False) -> DataFrame:
    """``(query_id, query…, prompt, num_retrieved)``; documents in rank order.

    A query's documents are at most the asked k, so the list per query is short. A query
    without documents has an empty context.
    """
    block = F.struct("rank", context_block(F.col("source"), F.col("content")).alias("text"))
    aggs = [F.array_sort(F.collect_list(block)).alias("_blocks")]
    if with_documents:
        doc = F.struct("rank", "id", "score", "content", "source", "metadata")
        aggs.append(F.collect_list(doc).alias("_docs"))
    lists = results.groupBy("query_id").agg(*aggs)
    context = F.array_join(
        F.transform(F.col("_blocks"), lambda b: b["text"]), BLOCK_SEPARATOR
    )
    out = queries.join(lists, "query_id", "left").select(
        *queries.columns,
        prompt_text(F.coalesce(context, F.lit("")), F.col("query")).alias("prompt"),
        F.coalesce(F.size("_blocks"), F.lit(0)).alias("num_retrieved"),
        *([F.expr("array_sort(_docs, (l, r) -> l.rank - r.rank)").alias("retrieved_documents")]
          if with_documents else []),
    )
    return out


def generate_echo(prompts: DataFrame, max_tokens: int | str = 500) -> DataFrame:
    """Add ``answer``: a fixed head and the first ``max_tokens`` characters of the prompt.

    ``max_tokens`` is a number or the name of a column.
    """
    n = F.col(max_tokens) if isinstance(max_tokens, str) else F.lit(max_tokens)
    return prompts.withColumn(
        "answer", F.concat(F.lit(ECHO_HEAD), F.substring(F.col("prompt"), F.lit(1), n))
    )


def generate(
    prompts: DataFrame,
    make_client: Callable[[], Callable[[str, int, float], str]],
    max_tokens: int = 500,
    temperature: float = 0.7,
) -> DataFrame:
    """Add ``answer`` and ``error`` from a plug-in generator.

    ``make_client`` runs once per task and returns ``generate(prompt, max_tokens,
    temperature) -> text``. A failing prompt gets its error text, the others go on.
    ``max_tokens`` and ``temperature`` columns of ``prompts`` win over the arguments.
    """
    from pyspark.sql import types as T

    schema = T.StructType([
        *prompts.schema.fields,
        T.StructField("answer", T.StringType()), T.StructField("error", T.StringType()),
    ])
    columns = prompts.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make_client()
        for batch in batches:
            answers, errors = [], []
            tokens = batch["max_tokens"] if "max_tokens" in columns else [max_tokens] * len(batch)
            temps = (batch["temperature"] if "temperature" in columns
                     else [temperature] * len(batch))
            for text, n, t in zip(batch["prompt"], tokens, temps):
                try:
                    answers.append(call(text, int(n), float(t)))
                    errors.append(None)
                except Exception as e:  # one bad prompt must not end the job
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield batch.assign(answer=answers, error=errors)

    return prompts.mapInPandas(run, schema)


def embed(
    docs: DataFrame, make_encoder: Callable[[], Callable[[list[str]], list[list[float]]]],
    key: str = "ord", text_col: str = "content",
) -> DataFrame:
    """``(key, embedding)`` from a plug-in encoder, called once per batch of texts.

    The encoder is made once per task. Values that are not text are turned into text.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_encoder()
        for b in batches:
            vectors = encode(["" if t is None else str(t) for t in b["_text"]])
            yield pd.DataFrame({
                key: b[key], "embedding": [list(map(float, v)) for v in vectors]
            })

    texts = docs.select(F.col(key).cast("bigint").alias(key),
                        F.col(text_col).cast("string").alias("_text"))
    return texts.mapInPandas(run, f"{key} bigint, embedding array<float>")


def answer(
    index: retrieval.Index, queries: DataFrame, num_retrieval: int = 5,
    max_tokens: int | str = 500,
) -> DataFrame:
    """Search, prompt and echo answer for every query, with the retrieved documents."""
    results = retrieval.search(index, queries, num_retrieval)
    if "num_retrieval" in queries.columns:
        own = queries.select("query_id", "num_retrieval")
        results = results.join(own, "query_id").filter(F.col("rank") <= F.col("num_retrieval"))
        results = results.drop("num_retrieval")
    prompts = build_prompts(results, queries, with_documents=True)
    return generate_echo(prompts, max_tokens)
