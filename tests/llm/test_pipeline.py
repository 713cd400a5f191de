"""The corpus pipeline against a plain version, and the registered queries against their SQL."""

import oracle_check
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from tallyloom.llm import quality, registered
from test_documents import jaccard_by_hand, plain_words, quality_by_hand, secrets_by_hand

SP = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def cut_windows(text, windows):
    """The text without hit words, cut again until none is left; None if most words go."""
    import re
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    n, lost = len(plain_words(text)), 0
    while True:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        places = [m.span() for m in word.finditer(low)]
        words = [low[s:e] for s, e in places]
        hit = set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if tuple(words[i:i + size]) in windows:
                    hit |= set(range(i, i + size))
        if not hit:
            return text if 100 * lost <= 50 * n else None
        lost += len(hit)
        runs = [(i, next(j for j in range(i, len(words) + 1) if j not in hit)) for i in sorted(hit) if i - 1 not in hit]
        for i, j in reversed(runs):
            text = text[:places[i][0]] + text[places[j - 1][1]:]


def test_pipeline_by_hand(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    kept = {}
    for d, t in docs.items():
        n, *_, failed = quality_by_hand(t)
        lines = [x for x in t.split("\n")]
        good = [x for x in lines if not quality.words_of(x) or not quality.line_fails(quality.words_of(x), x)]
        lost = n - sum(len(quality.words_of(x)) for x in good)
        if not failed and 2 * lost <= n:
            kept[d] = "\n".join(good)
    ids = sorted(kept)
    groups = jaccard_by_hand([kept[d] for d in ids])
    kept = {d: kept[d] for i, d in enumerate(ids) if groups[i][1] == i}
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = plain_words(r.text)
        windows |= {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    out = {}
    for d, t in kept.items():
        t = cut_windows(t, windows)
        if t is None:
            continue
        spans, text, at = secrets_by_hand(t), [], 0
        for kind, s, e in spans:
            if s >= at:
                text += [t[at:s], f"[{kind}]"]
            at = max(at, e)
        t = "".join([*text, t[at:]])
        out[d] = (SP.encode(t), t)
    got = {r.doc_id: (list(r.ids), r.text) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == out


def test_stages_return_the_columns_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_take_nulls(spark, sf):
    docs = spark.createDataFrame(
        [(None, None, None, None, None), (1, None, "en", "s", 0), (1, "a b", "en", "s", 3), (None, "x " * 60, None, None, 1)],
        spark.read.parquet(f"{sf}/documents.parquet").schema)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).collect()


A, B = "one two three four five six seven", "un deux trois quatre cinq six sept"


@pytest.mark.parametrize("rows, kept", [
    ([(1, A), (1, B), (2, B)], [(1, A), (1, B)]),  # one id, unlike texts
    ([(2, A), (1, A.upper()), (3, A)], [(1, A.upper())]),  # exact copies under several ids
    ([(None, A), (4, A), (None, B), (None, B)], [(4, A), (None, B)]),
    ([(1, A), (1, A), (1, A + " ")], [(1, A)]),
    ([(1, None), (1, ""), (1, None), (None, None), (2, ""), (None, "!")],
     [(1, None), (1, ""), (None, None), (2, ""), (None, "!")]),
    ([], []),
])
def test_dedup_goes_by_text(spark, sf, rows, kept):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], schema)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.jaccard_dedup(spark, docs, sf).collect()]
    if rows[:1] == [(1, A)] and len(rows) == 3 and rows[1][0] == 1 and rows[1][1] == A:
        assert len(got) == 1 and got[0][1].strip() == A  # the same words under one id: one of them
    else:
        assert sorted(got, key=str) == sorted(kept, key=str)


@pytest.mark.parametrize("name", sorted(registered.SQL))
def test_queries_match_sql(spark, sf, name):
    con = oracle_check.duck(sf)
    assert oracle_check.compare(spark, con, sf, registered.QUERIES[name], registered.SQL[name])[0] is None


def test_every_operator_has_a_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registered.QUERIES)
    assert numbers == list(range(1, 14))
