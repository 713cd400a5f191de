"""Terms are counted by batch: no row per word, whatever the keys."""

from collections import Counter

from tallyloom.operators import tfidf

ROWS = [(1, "a b a b c"), (1, "b a"), (None, "a ﬁn a"), (2, None), (3, "é é e"), (4, "zz")]


def grams(text):
    words = {"é": "e", "é": "e", "ﬁn": "fin"}
    w = [words.get(x, x) for x in (text or "").split()]
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def test_counts_by_key(spark):
    docs = spark.createDataFrame(ROWS, "ord long, content string").repartition(3)
    terms = ["a", "b", "a b", "b a", "e e", "fin", "fin a", "c", "c x"]
    known = spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, term_id int")
    counts = tfidf.term_counts(docs, known)
    want = Counter((k, terms.index(g)) for k, t in ROWS for g in grams(t) if g in terms)
    assert {(r["ord"], r["term_id"]): r["tf"] for r in counts.collect()} == want
    assert "Generate" not in counts._jdf.queryExecution().optimizedPlan().toString()
    assert tfidf.term_counts(docs, known.limit(0)).count() == 0


def test_top_terms_when_words_are_too_many_to_hand_out(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, "ord long, content string")
    total = Counter(g for _, t in ROWS for g in grams(t))
    for limit in (1, 3, 100):
        for held in (0, tfidf.HELD_WORDS):
            monkeypatch.setattr(tfidf, "HELD_WORDS", held)
            got = [tuple(r) for r in tfidf._exact_top(tfidf.tokens(docs, "ord", "content"), limit).collect()]
            assert got == sorted(total.items(), key=lambda x: (-x[1], x[0]))[:limit]
