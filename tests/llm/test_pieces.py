"""Token counts and the codec against the library, on given and on odd texts."""

import hashlib

import public_tokenizers
import pytest
import sentencepiece

from tallyloom.llm import pieces, registered, sp_codec, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = [
    None, "", " ", "  ", "a", "a ", " a", "a  b   c    ", "▁", "▁▁", "x▁ y", "\n", "\t\r\n\x0b\x0c", "\0 \0",
    "<s> </s> <unk> [INST] <0x0A>", "ﬁ ½ é é", "12345 678", "😀 👩‍👩‍👧 ‍", "日本語 テキスト です", "﻿x", "　y",
    "a" * 5000, "ab " * 20000, "the the the", "\U0010fffd ",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 3 else None, t, "clash") for i, t in enumerate(ODD)] + [(1, "repeated row", "clash")] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def expected(text):
    ids = SP.encode(text or "")
    return ids, SP.decode(ids)


def test_counts_match_the_library(docs):
    got = sorted((r.doc_id is None, r.doc_id, r.n_bytes, r.n_tokens, r.over_limit)
                 for r in token_counts.count_tokens(docs, PATH).collect())
    want = sorted((r.doc_id is None, r.doc_id, len((r.text or "").encode()), len(expected(r.text)[0]),
                   len(expected(r.text)[0]) > 4096) for r in docs.collect())
    assert got == want


def test_whole_tokens_are_proven_one_by_one():
    whole = pieces.whole_tokens(SP)
    assert len(whole) > 10_000
    assert all(SP.encode(w[1:]) == [SP.piece_to_id(w)] for w in whole[:500] if len(w) > 1)
    assert pieces.splits_at_markers(SP)


def test_codec_matches_the_library(spark, docs, monkeypatch):
    # small bounds: many batches and many buckets
    monkeypatch.setattr(sp_codec, "BATCH_CHUNKS", 7)
    monkeypatch.setattr(sp_codec, "ENCODE_CHUNKS", 3)
    rows = sp_codec.decode(sp_codec.encode(docs, PATH), PATH)
    got = sorted((str(r.doc_id), list(r.ids), r.text) for r in rows.collect())
    want = sorted((str(r.doc_id), *expected(r.text)) for r in docs.collect())
    assert got == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.count_tokens(none, PATH).count() == 0
    assert sp_codec.encode(none, PATH).count() == 0


def test_queries_match_the_library(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}

    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    for r in registered.op1(spark, sf).collect():
        assert r.n_tokens == len(SP.encode(docs[r.doc_id])) and r.n_bytes == len(docs[r.doc_id].encode())
    rows = registered.op5(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids, text = expected(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(text))


def test_scratch_takes_the_coded_table_along(spark, docs, tmp_path):
    from tallyloom import session

    before = {t.name for t in spark.catalog.listTables()}
    with session.scratch(spark):
        sp_codec.digests(sp_codec.encode(docs, PATH), PATH).write.parquet(str(tmp_path / "out"))
        assert {t.name for t in spark.catalog.listTables()} - before
    assert {t.name for t in spark.catalog.listTables()} == before
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()
