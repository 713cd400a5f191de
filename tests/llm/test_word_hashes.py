"""Word hashes against words split one by one."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm import jaccard_join, word_hashes


def texts():
    random.seed(1)
    out = [None, "", "  ", "A b\tc", "a B c", "x" * 10, "é è Ü", None, "\x0b\x0c", "a\xa0b"]
    out += [" ".join(random.choices(["aa", "Bb", "ccc\n", "é", "a"], k=random.randint(0, 300))) for _ in range(200)]
    return out + ["z " * 5000, "q" * 9000 + " end", "", None]


@pytest.mark.parametrize("segment", [1 << 20, 1000, 64])
def test_one_hash_per_word(monkeypatch, segment):
    monkeypatch.setattr(word_hashes, "SEGMENT", segment)
    hashes, known = word_hashes.WordHashes(), {}
    column = pa.array(["skipped", *texts()])[1:]  # a slice, with an offset
    for text, got in zip(texts(), hashes.of_texts(column), strict=True):
        words = word_hashes.words_of(text or "")
        assert len(words) == len(got)
        for w, h in zip(words, got.tolist()):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_shingles_are_those_of_the_words():
    hashes = word_hashes.WordHashes()
    for text in texts():
        words = word_hashes.words_of(text or "")
        own = {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        (h,) = hashes.of_texts(pa.array([text], pa.string()))
        assert len(jaccard_join.shingles(h)) == len(own)


def test_least_shared_and_matches():
    assert [jaccard_join.least_shared(n) for n in (1, 4, 5, 6, 100)] == [1, 4, 4, 5, 80]
    # common tokens at the end of the prefix make a longer one dear
    assert jaccard_join.choose_matches(np.array([1.0, 1, 1, 1, 900]), 10) == 2
    assert jaccard_join.choose_matches(np.array([50.0, 50, 50, 1, 1]), 10) == 3
