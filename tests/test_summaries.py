"""Frequent-item summaries and the inverted file with block maxima against plain counting and full scans."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import frequent, knn as nn, postings, retrieval, tfidf


def values_frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v string").repartition(7)


def zipf(seed, n, distinct):
    rng = np.random.default_rng(seed)
    p = 1 / np.arange(1, distinct + 1)
    return [f"t{i}" for i in rng.choice(distinct, n, p=p / p.sum())]


@pytest.mark.parametrize("items", [96, 384, 3 << 16])
def test_estimates_are_bounded(spark, items):
    values = zipf(1, 40_000, 5_000)
    true = Counter(values)
    listed, n, error = frequent.estimates(values_frame(spark, values + [None] * 50), "v", items)
    got = {r["item"]: r["estimate"] for r in listed.collect()}
    assert n == len(values) and len(got) <= items
    assert all(true[v] <= e <= true[v] + error for v, e in got.items())
    assert all(c <= 2 * error for v, c in true.items() if v not in got)
    if items == 3 << 16:
        assert error == 0 and got == true


@pytest.mark.parametrize("k", [1, 5, 20])
def test_candidates_hold_the_most_frequent(spark, k):
    values = zipf(2, 60_000, 20_000)
    best = sorted(Counter(values).items(), key=lambda x: (-x[1], x[0]))[:k]
    found = frequent.candidates(values_frame(spark, values), "v", k, 3072)
    assert found.error > 0 and found.listed <= 3072
    assert {v for v, _ in best} <= {r["item"] for r in found.candidates.collect()}
    assert found.kept < found.listed


def test_flat_counts_are_left_to_the_exact_way(spark):
    """No summary can tell among equal counts; all words are counted then, and none is lost."""
    words = [f"w{i:04}" for i in range(2_000)]
    docs = spark.createDataFrame(
        [(" ".join(random.Random(i).sample(words, 2_000)),) for i in range(4)] + [("w0007 w0007",)], "content string")
    got, found = tfidf.top_terms_found(docs, max_features=3, items=96)
    assert found.candidates is None and found.error > 0 and found.rows == sum(2 * 2_000 - 1 for _ in range(4)) + 3
    assert [tuple(r) for r in got.collect()] == [("w0007", 6), ("w0000", 4), ("w0001", 4)]
    same, found = tfidf.top_terms_found(docs, max_features=3)
    assert found.candidates is not None and found.error == 0
    assert [tuple(r) for r in same.collect()] == [("w0007", 6), ("w0000", 4), ("w0001", 4)]


def test_few_candidates_are_counted(spark):
    docs = spark.createDataFrame([(" ".join(zipf(i, 3_000, 4_000)),) for i in range(6)], "content string")
    got, found = tfidf.top_terms_found(docs, max_features=10, items=6_144)
    exact, sure = tfidf.top_terms_found(docs, max_features=10)
    assert found.error > 0 and 10 <= found.kept < 200 and sure.error == 0
    assert got.collect() == exact.collect()


def test_fitting_falls_back_to_the_exact_way(spark, monkeypatch):
    words = [f"w{i:04}" for i in range(500)]
    docs = spark.createDataFrame(
        [(i, " ".join(random.Random(i).sample(words, 500))) for i in range(4)] + [(4, None), (5, "w0003")],
        "ord long, content string")
    want = sorted(map(str, tfidf.fit(docs, max_features=40, by_summary=True).collect()))
    _, vectors = tfidf.fit_transform(docs, max_features=40, by_summary=True)
    want_vectors = sorted((r.ord, list(r.term_ids), [round(w, 9) for w in r.weights]) for r in vectors.collect())
    first = frequent.candidates
    monkeypatch.setattr(frequent, "candidates", lambda v, c, k: first(v, c, k, 48))
    assert frequent.candidates(docs, "content", 1).rows == 5
    assert sorted(map(str, tfidf.fit(docs, max_features=40, by_summary=True).collect())) == want
    _, vectors = tfidf.fit_transform(docs, max_features=40, by_summary=True)
    assert sorted((r.ord, list(r.term_ids), [round(w, 9) for w in r.weights]) for r in vectors.collect()) == want_vectors


def test_no_values(spark):
    found = frequent.candidates(values_frame(spark, [None]), "v", 3)
    assert (found.rows, found.error, found.kept) == (0, 0, 0) and found.candidates.count() == 0


# inverted file --------------------------------------------------------------------------------

SPARSE = "ord long, term_ids array<int>, weights array<double>"


def topic_vectors(rng, n, topics=40):
    """Three or more of ten words of a topic, and light words that all topics share."""
    out = []
    for i in range(n):
        own = {100 + 10 * (i % topics) + t: rng.choice([2.0, 3.0]) for t in rng.sample(range(10), rng.randint(3, 8))}
        own.update({t: 0.3 for t in rng.sample(range(100), 6)})
        norm = sum(x * x for x in own.values()) ** .5
        out.append((i, sorted(own), [own[t] / norm for t in sorted(own)]))
    return out


def sparse_vectors(rng, n, terms, most):
    out = []
    for i in range(n):
        ids = sorted(rng.sample(range(terms), rng.randint(0, most)))
        w = [rng.choice([0.5, 1.0, 1.0, rng.random() + 0.01]) for _ in ids]
        norm = sum(x * x for x in w) ** .5
        out.append((i, ids, [x / norm for x in w]))
    return out


@pytest.mark.parametrize("seed, n, block, k", [(0, 300, 16, 5), (1, 300, 1, 3), (2, 90, 1000, 7), (3, 40, 8, 100), (4, 300, 7, 1)])
def test_pruned_search_equals_the_full_scan(spark, seed, n, block, k):
    rng = random.Random(seed)
    rows = sparse_vectors(rng, n, 30, 6)
    rows += [(n + i, *rows[i][1:]) for i in range(20)]  # ties
    vectors = spark.createDataFrame(rows, SPARSE).repartition(5)
    asked = [(i, *r[1:]) for i, r in enumerate(sparse_vectors(rng, 12, 30, 8))] + [
        (100, [], []), (101, [29999], [1.0]), (102, *rows[3][1:]), (None, [1], [1.0])]
    queries = spark.createDataFrame(asked, SPARSE.replace("ord", "query_id"))
    held = postings.build(vectors, block)
    assert held.agg(F.max("n")).first()[0] <= block
    got, work = postings.match(held, vectors, queries, k)
    full = nn.knn(queries, vectors, k, "cosine", dim=30_000, sparse=True)
    key = lambda r: (r["query_id"], r["rank"])
    assert sorted(got.collect(), key=key) == sorted(full.select(*got.columns).collect(), key=key)
    for r in work.collect():
        assert 0 < r["blocks_read"] <= r["blocks"] and 0 < r["postings_read"] <= r["postings"]


def test_blocks_that_cannot_win_are_not_read(spark, tmp_path):
    rng = random.Random(8)
    rows = topic_vectors(rng, 2_000)
    vectors = spark.createDataFrame(rows, SPARSE).repartition(4)
    postings.save(postings.build(vectors, 20), str(tmp_path))
    held = postings.load(spark, str(tmp_path))
    queries = spark.createDataFrame([(i, *rows[i][1:]) for i in range(1, 40, 3)], SPARSE.replace("ord", "query_id"))
    got, work = postings.match(held, vectors, queries, 3)
    full = nn.knn(queries, vectors, 3, "cosine", dim=600, sparse=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, full.select(*got.columns).collect()))
    done = work.agg(F.sum("postings_read"), F.sum("postings"), F.sum("blocks_read"), F.sum("blocks")).first()
    assert done[0] < 0.5 * done[1] and done[2] < 0.5 * done[3]
    terms = queries.agg(F.sum(F.size("term_ids"))).first()[0]
    assert done[0] < 0.1 * len(rows) * terms
    plan = held.filter(F.col("slot").isin([1, 3]))._jdf.queryExecution().toString()
    assert "slot" in plan.split("PartitionFilters: [")[1].split("]")[0]  # folders of other terms are not listed


def test_inverted_file_of_nothing(spark):
    none = spark.createDataFrame([], SPARSE)
    query = spark.createDataFrame([(1, [2], [1.0])], SPARSE.replace("ord", "query_id"))
    assert postings.match(postings.build(none), none, query)[0].count() == 0
    empty = spark.createDataFrame([(4, [], []), (2, None, None)], SPARSE)
    got, work = postings.match(postings.build(empty), empty, query, 5)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 2, 0.0), (1, 2, 4, 0.0)] and work.count() == 0
    with pytest.raises(Exception, match="negative"):
        postings.build(spark.createDataFrame([(1, [1], [-1.0])], SPARSE)).collect()


def test_pruned_search_is_for_cosine(spark):
    with pytest.raises(ValueError):
        retrieval.search_pruned(retrieval.Index(None, None, None, "l2"), None, None)
