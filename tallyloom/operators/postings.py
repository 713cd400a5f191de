"""Exact top-k search that skips: an inverted file with the largest weight per block of documents.

Documents lie in blocks of similar ones. For every term and block there is one row: its documents, their
weights and the largest of these. A query's terms and the largest weights bound what any document of a
block can score. The blocks with the highest bounds are scored first; a block whose bound is below the
k-th best score found there cannot hold a result and is not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyloom.functions.numeric import round_even
from tallyloom.operators import ordered
from tallyloom.operators.knn import SCORE_PLACES
from tallyloom.session import settle
from tallyloom.sources import versions

# Documents in a block, about.
BLOCK_DOCS = 128
# Folders that the terms are dealt into, so that a search lists those of its terms only.
SLOTS = 64
# Heaviest terms by which documents are laid side by side.
_LIKE = 3
# What rounding of scores and sums may add to a bound.
_SLACK = 10.0 ** -SCORE_PLACES


def _slot(term: Column) -> Column:
    return F.pmod(term, F.lit(SLOTS)).cast("int")


def build(vectors: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(slot, term_id, block, ords, weights, n, top) of vectors ``(ord, term_ids, weights)``.

    Documents are numbered by their heaviest terms, and so many make a block. A row holds at most a block's
    documents, so a term that all documents have is spread over as many rows as there are blocks. Weights
    must not be negative; null and empty vectors have no rows.
    """
    heavy = F.slice(F.array_sort(F.zip_with(
        "term_ids", "weights", lambda t, w: F.struct((-w).alias("w"), t.alias("t")))), 1, _LIKE)
    like = vectors.select("ord", "term_ids", "weights", F.transform(heavy, lambda x: x["t"]).alias("_like")) \
        .filter(F.size("term_ids") > 0)
    placed = ordered.positions(like, [], ["_like", "ord"], unique=True)
    weight = F.when(F.col("p.weights") < 0, F.raise_error(F.lit("a weight is negative")).cast("double")) \
        .otherwise(F.col("p.weights"))
    rows = placed.select("ord", F.floor(F.col("_pos") / block_docs).alias("block"),
                         F.explode(F.arrays_zip("term_ids", "weights")).alias("p")) \
        .select("ord", "block", F.col("p.term_ids").alias("term_id"), weight.alias("weight")).filter("weight != 0")
    lists = rows.groupBy("term_id", "block").agg(F.sort_array(F.collect_list(F.struct("ord", "weight"))).alias("l"))
    return lists.select(
        _slot(F.col("term_id")).alias("slot"), "term_id", "block",
        F.transform("l", lambda e: e["ord"]).alias("ords"), F.transform("l", lambda e: e["weight"]).alias("weights"),
        F.size("l").alias("n"), F.array_max(F.transform("l", lambda e: e["weight"])).alias("top"))


def save(postings: DataFrame, path: str) -> None:
    """Replace the inverted file at ``path``: rows by term and block, in a folder per slot."""
    order = ["slot", "term_id", "block"]
    laid = postings.repartitionByRange(*order).sortWithinPartitions(*order)
    versions.save(postings.sparkSession, path, {"postings": laid}, by={"postings": ["slot"]})


def load(spark: SparkSession, path: str) -> DataFrame:
    return versions.load(spark, path, "postings")[0]


def _scored(asked: DataFrame, blocks: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, ord, score) of every document that has a term of the query in one of its blocks."""
    entries = asked.join(blocks, "query_id").join(
        postings.select("term_id", "block", "ords", "weights"), ["term_id", "block"])
    return entries.select("query_id", "weight", F.explode(F.arrays_zip("ords", "weights")).alias("e")) \
        .groupBy("query_id", F.col("e.ords").alias("ord")) \
        .agg(round_even(F.sum(F.col("weight") * F.col("e.weights")), SCORE_PLACES).alias("score"))


def _best(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("ord"))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def match(
    postings: DataFrame, documents: DataFrame, queries: DataFrame, k: int = 5
) -> tuple[DataFrame, DataFrame]:
    """((query_id, rank, ord, score), (query_id, blocks, blocks_read, postings, postings_read)).

    The k best ``documents (ord)`` for every query ``(query_id, term_ids, weights)``, as the full scan gives
    them: scores are rounded, ties go to the smaller ``ord``, documents with score 0 fill up, k is at least 1
    and at most the number of documents. A query without an id has no result. The second table says what
    the query's terms have in the file and how much of it was read; a query without a known term is not in it.
    """
    k = max(int(k), 1)
    known = queries.filter("query_id IS NOT NULL")
    asked = settle(
        known.select("query_id", F.explode(F.arrays_zip("term_ids", "weights")).alias("t"))
        .select("query_id", F.col("t.term_ids").alias("term_id"), F.col("t.weights").alias("weight"))
        .filter("weight > 0"), "query-terms")
    slots = [r[0] for r in asked.select(_slot(F.col("term_id"))).distinct().collect()]  # at most SLOTS
    listed = postings.filter(F.col("slot").isin(slots))
    bounds = settle(
        listed.select("term_id", "block", "top", "n").join(asked, "term_id").groupBy("query_id", "block")
        .agg(F.sum(F.col("weight") * F.col("top")).alias("bound"), F.sum("n").alias("n")), "bounds")

    # k blocks hold at least k documents with a term of the query
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("bound"), F.asc("block"))
    first = settle(bounds.withColumn("_rank", F.row_number().over(by_bound)).filter(F.col("_rank") <= k)
                   .select("query_id", "block"), "first-blocks")
    found = settle(_best(_scored(asked, first, listed), k).drop("rank"), "first-scores")
    least = found.groupBy("query_id").agg(F.count("*").alias("held"), F.min("score").alias("least")) \
        .filter(F.col("held") >= k).select("query_id", "least")
    rest = settle(
        bounds.join(first, ["query_id", "block"], "left_anti").join(least, "query_id", "left")
        .filter(F.col("bound") + _SLACK >= F.coalesce("least", F.lit(0.0))).select("query_id", "block"), "more-blocks")
    top = settle(_best(found.union(_scored(asked, rest, listed)), k).drop("rank"), "scores")

    # of the 2 k first documents fewer than k score, if fewer than k score at all
    full = top.filter("score > 0").groupBy("query_id").agg(F.count("*").alias("held")).filter(F.col("held") >= k)
    fill = documents.select("ord").orderBy("ord").limit(2 * k).agg(F.sort_array(F.collect_list("ord")))
    zeros = known.select("query_id").distinct().join(full, "query_id", "left_anti") \
        .select("query_id", F.explode(fill.scalar()).alias("ord"), F.lit(0.0).alias("score"))
    both = top.union(zeros).groupBy("query_id", "ord").agg(F.max("score").alias("score"))

    read = first.union(rest).withColumn("_read", F.lit(1))
    work = bounds.join(read, ["query_id", "block"], "left").groupBy("query_id").agg(
        F.count("*").alias("blocks"), F.count("_read").alias("blocks_read"), F.sum("n").alias("postings"),
        F.coalesce(F.sum(F.when(F.col("_read") == 1, F.col("n"))), F.lit(0)).alias("postings_read"))
    return _best(both, k).select("query_id", "rank", "ord", "score"), work
