"""Words of a text: lower case, no accents, and the word that follows each."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Fixed value: a word is a run of letters, digits and underscores of any script.
WORD = r"([\p{L}\p{N}_]+)"


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str, str]:
    """By rule from the Unicode data: characters whose plain form is one other character, those forms, and
    combining marks, which have none."""
    source, target, deleted = [], [], []
    for cp in range(0x80, 0x20000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        c = chr(cp)
        plain = _plain(c)
        if plain == c:
            continue
        if len(plain) == 1:
            source.append(c)
            target.append(plain)
        elif not plain:
            deleted.append(c)
    return "".join(source), "".join(target), "".join(deleted)


def _make_plain():
    """Plain form of a text: of its stretches beyond ASCII, which are short and come again and again."""
    known = lru_cache(maxsize=1 << 16)(_plain)
    odd = re.compile(r"[^\x00-\x7f]{1,16}")
    return lambda text: text if text.isascii() else odd.sub(lambda m: known(m[0]), text)


@F.pandas_udf(T.StringType())
def _strip_accents_exact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    plain = _make_plain()
    for texts in batches:
        yield texts.map(lambda s: None if s is None else plain(s))


def strip_accents(c: Column, exact: bool = True) -> Column:
    """Remove accents and expand ligatures, fractions and the like, by an Arrow function.

    With ``exact=False`` the JVM translates the characters that have a plain form of one character, or none, and
    those with a longer one stay.
    """
    if exact:
        return _strip_accents_exact(c)
    source, target, deleted = _accent_table()
    return F.translate(c, source + deleted, target)


def words(c: Column, exact_accents: bool = True) -> Column:
    return F.regexp_extract_all(strip_accents(F.lower(c), exact_accents), F.lit(WORD), F.lit(1))


def with_next(tokens: Column) -> Column:
    """Array of (a, b): every word and the one after it, null after the last."""
    return F.arrays_zip(
        tokens.alias("a"), F.slice(tokens, F.lit(2), F.size(tokens)).alias("b")
    )
