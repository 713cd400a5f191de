"""TF-IDF vectors over the most frequent words and word pairs.

Fit and transform are separate: queries and later documents use the fitted vocabulary.
A vector is a pair of arrays ``(term_ids, weights)`` of unit length, empty for a text
without known terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from tallyloom.functions.text import with_next, words
from tallyloom.operators import frequent
from tallyloom.session import settle

MAX_FEATURES = 1000
# Distinct words that every task may be handed, to count pairs of them by batch.
HELD_WORDS = 200_000

# Column of the array of a text's words.
_W = "_words"


def tokens(docs: DataFrame, key: str, text_col: str, exact_accents: bool = True) -> DataFrame:
    """``(key, _words)``: every text as the array of its words, null as none."""
    return docs.select(key, words(F.coalesce(F.col(text_col), F.lit("")), exact_accents).alias(_W))


def _pairs(split: DataFrame, keep: list[str]) -> DataFrame:
    """One row ``(keep…, a, b)`` per word; b is the word after it, null at the end.

    The outer explode keeps the planner from adding a filter on the array below it, which
    would work the array out again.
    """
    rows = split.select(*keep, F.explode_outer(with_next(F.col(_W))).alias("_p"))
    return rows.select(*keep, F.col("_p.a").alias("a"), F.col("_p.b").alias("b")).filter(
        F.col("a").isNotNull())


def _pair_text():
    return F.concat("a", F.lit(" "), "b")


def _grams(split: DataFrame, keep: list[str]) -> DataFrame:
    """One row ``(keep…, term)`` per word and per pair."""
    both = _pairs(split, keep).select(*keep, F.explode(F.array(F.col("a"), _pair_text())).alias("term"))
    return both.filter(F.col("term").isNotNull())


def _coded(texts: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``known`` or -1, number of the text) of every word of a batch of word arrays."""
    words = pc.list_flatten(texts).dictionary_encode()
    places = pc.fill_null(pc.index_in(words.dictionary, value_set=known), -1).to_numpy(zero_copy_only=False)
    at = words.indices.to_numpy(zero_copy_only=False)
    return places[at].astype(np.int64), pc.list_parent_indices(texts).to_numpy(zero_copy_only=False)


def _coded_pairs(code: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(a · n + b, number of the text) of all neighbouring known words a, b of a text."""
    both = (text[1:] == text[:-1]) & (code[1:] >= 0) & (code[:-1] >= 0)
    return code[:-1][both] * n + code[1:][both], text[:-1][both]


def _word_counts(split: DataFrame) -> DataFrame:
    """(term, corpus_count) of all words; a task hands on the sums of its batches."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pc.list_flatten(b.column(0)).value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["term", "n"])

    rows = split.select(_W).mapInArrow(count, "term string, n long")
    return rows.filter(F.col("term").isNotNull()).groupBy("term").agg(F.sum("n").alias("corpus_count"))


def _pair_counts(split: DataFrame, kept: DataFrame) -> DataFrame:
    """(term, corpus_count) of the pairs of two of the words ``kept (term)``.

    If these are not too many for every task, a task hands on the sums of its batches; else pairs are joined
    with them one by one.
    """
    if kept.count() > HELD_WORDS:
        both = _pairs(split, []).filter(F.col("b").isNotNull())
        for c in ("a", "b"):
            both = both.join(kept.select(F.col("term").alias(c)), c, "left_semi")
        return both.groupBy("a", "b").agg(F.count("*").alias("corpus_count")).select(
            _pair_text().alias("term"), "corpus_count")
    held = [r[0] for r in kept.select("term").collect()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = pa.array(held, pa.string()), max(1, len(held))
        for b in batches:
            pairs, sums = np.unique(_coded_pairs(*_coded(b.column(0), known), n)[0], return_counts=True)
            texts = pc.binary_join_element_wise(known.take(pa.array(pairs // n)), known.take(pa.array(pairs % n)), " ")
            yield pa.RecordBatch.from_arrays([texts, pa.array(sums, pa.int64())], ["term", "n"])

    return split.select(_W).mapInArrow(count, "term string, n long").groupBy("term").agg(
        F.sum("n").alias("corpus_count"))


def _exact_top(split: DataFrame, max_features: int) -> DataFrame:
    """The most frequent words and pairs of written ``(…, _words)`` rows, however flat their counts.

    Words are counted first. A pair is at most as frequent as either of its words, so only pairs of words
    that reach the count of the last kept word can be among the top; the others are not counted, which
    keeps the table of all distinct pairs out of the shuffle.
    """
    single = settle(_word_counts(split), "words")
    last = _first(single, max_features).agg(
        F.count("*").alias("n"), F.min("corpus_count").alias("least")
    ).first()
    least = last["least"] if last["n"] == max_features else 0
    frequent_words = settle(single.filter(F.col("corpus_count") >= least), "words")
    return _first(frequent_words.unionByName(_pair_counts(split, frequent_words)), max_features)


def _found_terms(split: DataFrame, known: DataFrame, label: str, key: str | None = None) -> DataFrame:
    """(key, label, n): how often the terms of ``known (term, …)`` stand in the texts, under their ``label``.

    The known terms go to every task, which counts them by batch: a text has one row per term. Without ``key``
    the sums of whole batches come back.
    """
    rows = known.select(F.col("term"), F.col(label).alias("label")).collect()
    terms, labels = [r["term"] for r in rows], [r["label"] for r in rows]
    kind = to_arrow_type(known.schema[label].dataType)
    fields = [*([split.schema[key]] if key else []), T.StructField(label, known.schema[label].dataType),
              T.StructField("n", T.LongType())]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [t.split(" ", 1) for t in terms]
        words = list(dict.fromkeys(w for p in parts for w in p))
        held, place = pa.array(words, pa.string()), {w: i for i, w in enumerate(words)}
        n, of_word = len(words), np.full(len(words) + 1, -1)  # the last one stands for unknown words
        pairs = {}
        for i, p in enumerate(parts):
            if len(p) == 1:
                of_word[place[p[0]]] = i
            else:
                pairs[place[p[0]] * n + place[p[1]]] = i
        pair_codes = np.array(sorted(pairs), np.int64)
        of_pair, named = np.array([pairs[c] for c in pair_codes], np.int64), pa.array(labels, kind)
        for b in batches:
            code, text = _coded(b.column(b.num_columns - 1), held)
            term = of_word[code]
            found, of = [term[term >= 0]], [text[term >= 0]]
            if len(pair_codes):
                both, where = _coded_pairs(code, text, n)
                at = np.minimum(np.searchsorted(pair_codes, both), len(pair_codes) - 1)
                hit = pair_codes[at] == both
                found.append(of_pair[at[hit]])
                of.append(where[hit])
            found, of = np.concatenate(found), np.concatenate(of).astype(np.int64)
            size = max(1, len(terms))
            cells, sums = np.unique(of * size + found if key else found, return_counts=True)
            of_text = [b.column(0).take(pa.array(cells // size))] if key else []
            yield pa.RecordBatch.from_arrays(
                [*of_text, named.take(pa.array(cells % size)), pa.array(sums, pa.int64())],
                [f.name for f in fields])

    return split.select(*([key] if key else []), _W).mapInArrow(count, T.StructType(fields))


def _first(terms: DataFrame, max_features: int) -> DataFrame:
    return terms.orderBy(F.desc("corpus_count"), F.asc("term")).limit(max_features)


def top_terms(
    docs: DataFrame, text_col: str = "content", max_features: int = MAX_FEATURES,
    exact_accents: bool = True, items: int = frequent.ITEMS,
) -> DataFrame:
    """``(term, corpus_count)`` of the most frequent words and pairs, ties by term."""
    return top_terms_found(docs, text_col, max_features, exact_accents, items)[0]


def top_terms_found(
    docs: DataFrame, text_col: str = "content", max_features: int = MAX_FEATURES,
    exact_accents: bool = True, items: int = frequent.ITEMS,
) -> tuple[DataFrame, frequent.Found]:
    """``top_terms``, and what the summary of the terms found.

    Each task sums its terms up in a summary of ``items`` counters; only the candidates that it leaves are
    counted, so neither the texts' words nor the table of all distinct terms is written or shuffled. If the
    counts are too flat for the summary to tell (``candidates`` is None), all words are counted.
    """
    split = docs.select(words(F.coalesce(F.col(text_col), F.lit("")), exact_accents).alias(_W))
    found = frequent.candidates(_grams(split, []), "term", max_features, items)
    if found.candidates is None:
        return _exact_top(settle(split, "tokens"), max_features), found
    few = found.candidates.withColumnRenamed("item", "term")
    counted = _found_terms(split, few, "term").groupBy("term").agg(F.sum("n").alias("corpus_count"))
    return _first(counted, max_features), found


def _numbered(top: DataFrame) -> DataFrame:
    """Kept terms with ``term_id`` in term order, written once."""
    by_term = Window.orderBy("term")  # at most max_features rows
    return settle(top.withColumn("term_id", F.row_number().over(by_term) - 1), "terms")


def _counts(split: DataFrame, numbered: DataFrame, key: str) -> DataFrame:
    return _found_terms(split, numbered, "term_id", key).groupBy(key, "term_id").agg(F.sum("n").alias("tf"))


def term_counts(
    docs: DataFrame, numbered: DataFrame, key: str = "ord", text_col: str = "content",
    exact_accents: bool = True,
) -> DataFrame:
    """``(key, term_id, tf)`` for the known terms of every text.

    Unknown terms go before the shuffle; a text's own terms are counted by batch.
    """
    return _counts(tokens(docs, key, text_col, exact_accents), numbered, key)


def _vocabulary(docs: DataFrame, numbered: DataFrame, seen: DataFrame) -> DataFrame:
    """idf = ln((1 + documents) / (1 + documents with the term)) + 1."""
    n = docs.agg(F.count("*")).scalar()
    vocab = numbered.join(seen, "term_id").select(
        "term", "term_id", "corpus_count", "doc_count",
        (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("doc_count"))) + 1.0).alias("idf"),
    )
    return settle(vocab, "vocabulary")


def _fit_counts(docs, key, text_col, max_features, exact_accents, by_summary):
    """(vocabulary, term counts per text), both written once.

    By default the words are written once and counted exactly, which is faster while the table of distinct words
    is small beside the texts. ``by_summary``: the candidates of the summary are counted per text and these
    counts give the kept terms, so the texts are split twice and neither their words nor all distinct ones are
    written or shuffled.
    """
    split = tokens(docs, key, text_col, exact_accents)
    found = frequent.candidates(_grams(split, []), "term", max_features) if by_summary else None
    if found is None or found.candidates is None:
        split = settle(split, "tokens")
        numbered = _numbered(_exact_top(split, max_features))
        counts = settle(_counts(split, numbered, key), "counts")
    else:
        few = settle(found.candidates.select(
            F.col("item").alias("term"), F.monotonically_increasing_id().alias("term_id")), "candidates")
        all_counts = settle(_counts(split, few, key), "counts")
        totals = all_counts.groupBy("term_id").agg(F.sum("tf").alias("corpus_count"))
        top = _first(few.join(totals, "term_id").withColumnRenamed("term_id", "_few"), max_features)
        numbered = _numbered(top)
        counts = all_counts.withColumnRenamed("term_id", "_few").join(
            numbered.select("_few", "term_id"), "_few").select(key, "term_id", "tf")
        numbered = numbered.drop("_few")
    seen = counts.groupBy("term_id").agg(F.count("*").alias("doc_count"))
    return _vocabulary(split, numbered, seen), counts


def fit(
    docs: DataFrame, key: str = "ord", text_col: str = "content",
    max_features: int = MAX_FEATURES, exact_accents: bool = True, by_summary: bool = False,
) -> DataFrame:
    """Vocabulary ``(term, term_id, corpus_count, doc_count, idf)``, written once."""
    return _fit_counts(docs, key, text_col, max_features, exact_accents, by_summary)[0]


def fit_transform(
    docs: DataFrame, key: str = "ord", text_col: str = "content",
    max_features: int = MAX_FEATURES, exact_accents: bool = True, by_summary: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, vectors); the term counts are written once and serve both."""
    vocab, counts = _fit_counts(docs, key, text_col, max_features, exact_accents, by_summary)
    return vocab, vectors(docs, counts, vocab, key)


def vectors(
    docs: DataFrame, counts: DataFrame, vocab: DataFrame, key: str = "ord",
) -> DataFrame:
    """``(key, term_ids, weights)`` for every row of ``docs``; weights have unit length."""
    w = counts.join(vocab.select("term_id", "idf"), "term_id").withColumn("weight", F.col("tf") * F.col("idf"))
    rows = w.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("term_id", "weight"))).alias("_v"),
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_norm"),
    ).select(
        key,
        F.transform("_v", lambda e: e["term_id"]).alias("term_ids"),
        F.transform("_v", lambda e: e["weight"] / F.col("_norm")).alias("weights"),
    )
    return docs.select(key).join(rows, key, "left").select(
        key,
        F.coalesce("term_ids", F.array().cast("array<int>")).alias("term_ids"),
        F.coalesce("weights", F.array().cast("array<double>")).alias("weights"),
    )


def transform(
    docs: DataFrame, vocab: DataFrame, key: str = "ord", text_col: str = "content",
    exact_accents: bool = True,
) -> DataFrame:
    """Vectors of texts on a fitted vocabulary; unknown terms do not count."""
    counts = term_counts(docs, vocab, key, text_col, exact_accents)
    return vectors(docs, counts, vocab, key)
