"""Document index and search: TF-IDF vectors, exact top-k, documents attached."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.operators import knn as nn, ordered, postings, tfidf
from tallyloom.sources import versions


@dataclass(frozen=True)
class Index:
    """``documents (ord, id, content, source, metadata)``, ``vectors (ord, term_ids, weights)``
    and the fitted ``vocabulary``."""

    documents: DataFrame
    vectors: DataFrame
    vocabulary: DataFrame
    metric: str = "cosine"
    max_features: int = tfidf.MAX_FEATURES


def number_documents(docs: DataFrame, order_cols: list[str], base=None) -> DataFrame:
    """Give rows ``ord`` in the given order and ids ``doc_{ord}`` where none are given."""
    pos = ordered.positions(docs, [], order_cols)
    place = F.col("_pos") if base is None else base + F.col("_pos")
    return with_ids(pos.withColumn("ord", place).drop("_pos"))


def with_ids(docs: DataFrame) -> DataFrame:
    """Documents that already have ``ord``: fill ids and empty metadata."""
    given = F.col("id") if "id" in docs.columns else F.lit(None).cast("string")
    meta = (F.col("metadata") if "metadata" in docs.columns
            else F.create_map().cast("map<string,string>"))
    return docs.select(
        F.col("ord").cast("bigint").alias("ord"),
        F.coalesce(given, F.concat(F.lit("doc_"), F.col("ord").cast("string"))).alias("id"),
        "content", "source", meta.alias("metadata"),
    )


def build_index(
    docs: DataFrame, metric: str = "cosine", max_features: int = tfidf.MAX_FEATURES
) -> Index:
    """Fit the vocabulary on ``docs (ord, content, source[, id, metadata])`` and embed them."""
    m = nn.check_metric(metric)
    named = with_ids(docs)
    vocab, vectors = tfidf.fit_transform(named, "ord", "content", max_features)
    if vocab.isEmpty():
        raise ValueError("the documents hold no word to index")
    return Index(named, vectors, vocab, m, max_features)


def add_documents(index: Index, docs: DataFrame, order_cols: list[str]) -> Index:
    """Add documents with the fitted vocabulary; numbers go on at the index size."""
    base = index.documents.agg(F.count("*")).scalar()
    named = number_documents(docs, order_cols, base)
    new = tfidf.transform(named, index.vocabulary, "ord", "content")
    return Index(
        index.documents.unionByName(named), index.vectors.unionByName(new),
        index.vocabulary, index.metric, index.max_features,
    )


def append(spark: SparkSession, path: str, docs: DataFrame, order_cols: list[str],
           seen: tuple[str, int] | None = None) -> int:
    """Add documents to the index saved at ``path``; several may do so at once.

    Documents and vectors show together. Numbers go on at what the index holds when the addition
    takes effect: who finds another addition there first numbers again. ``seen`` as in ``versions.change``.
    """
    def make(draft: versions.Draft) -> None:
        base = draft.read("documents").agg(F.count("*")).scalar()
        named = draft.add("documents", number_documents(docs, order_cols, base))
        draft.add("vectors", tfidf.transform(named, draft.read("vocabulary"), "ord", "content"))

    return versions.change(spark, path, make, seen)


def compact(spark: SparkSession, path: str) -> int:
    """Join the parts that additions have left; documents are laid out by number."""
    return versions.compact(spark, path, {"documents": ["ord"]})


def save(index: Index, path: str) -> None:
    """Replace the index at ``path``, which may be the one that ``index`` was loaded from.

    Documents are laid out by number, so that a search reads few row groups of them.
    """
    versions.save(index.documents.sparkSession, path, {
        "documents": index.documents.sortWithinPartitions("ord"), "vectors": index.vectors,
        "vocabulary": index.vocabulary})


def load(spark: SparkSession, path: str, metric: str = "cosine",
         max_features: int = tfidf.MAX_FEATURES) -> Index:
    """The saved index with all that was added to it so far."""
    docs, vectors, vocab = versions.load(spark, path, "documents", "vectors", "vocabulary")
    return Index(docs, vectors, vocab, metric, max_features)


def embed_queries(index: Index, queries: DataFrame) -> DataFrame:
    """``queries (query_id, query)`` → ``(query_id, term_ids, weights)``."""
    return tfidf.transform(queries, index.vocabulary, "query_id", "query")


def match(index: Index, queries: DataFrame, k: int = 5) -> DataFrame:
    """``(query_id, rank, ord, score)`` of the k best documents per query."""
    return nn.knn(
        embed_queries(index, queries), index.vectors, k, index.metric,
        dim=index.max_features, sparse=True,
    )


def attach_documents(matches: DataFrame, docs: DataFrame) -> DataFrame:
    """Matches with their documents; a match without one is dropped, ranks stay."""
    return docs.join(matches, "ord").select(
        "query_id", "rank", "id", "score", "content", "source", "metadata"
    )


def search(index: Index, queries: DataFrame, k: int = 5) -> DataFrame:
    """Ranked documents for every row of ``queries (query_id, query)``; one job for all."""
    return attach_documents(match(index, queries, k), index.documents)


def search_pruned(index: Index, held: DataFrame, queries: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """As ``search``, through the inverted file ``held`` of the index's vectors, with the work it took.

    For few questions against very many documents: blocks that cannot hold a result are not read.
    The file must be of the index as it is; cosine only.
    """
    if index.metric != "cosine":
        raise ValueError("bounds are for cosine scores")
    matches, work = postings.match(held, index.documents, embed_queries(index, queries), k)
    return attach_documents(matches, index.documents), work


def semantic_search(docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Build and search in one go."""
    return search(build_index(docs), queries, k)
