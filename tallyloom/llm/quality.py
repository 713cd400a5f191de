"""Quality rules, line first: clean line by line, then judge what is left of the document."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyloom.llm.common import arrow_schema, map_texts, sliced

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PCT = 50

# Rules of one line, with the shares in percent that make a line fail.
MAX_BARS_PCT = 25        # navigation: words that only separate, like "Home | News | Contact" or "Start » Sport"
MAX_MARKED_PCT = 50      # punctuation: words with two or more symbols or exclamation marks in a row
MAX_SAME_PCT = 50        # punctuation: words equal to the word before, in lines of some words
SAME_FROM_WORDS = 10
# Phrases that mark a short line as boilerplate, in lower case: English, German, French, Spanish.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "click here", "cookie policy", "log in",
    "privacy policy", "read more", "sign in", "subscribe now", "terms of service",
    "alle rechte vorbehalten", "cookies akzeptieren", "hier klicken", "jetzt abonnieren",
    "cookie-richtlinie", "mehr lesen", "nutzungsbedingungen",
    "accepter les cookies", "cliquez ici", "conditions d'utilisation", "lire la suite", "abonnez-vous",
    "politique de confidentialité", "se connecter", "tous droits réservés",
    "aceptar cookies", "haga clic aquí", "iniciar sesión", "leer más", "suscríbete",
    "política de privacidad", "términos de servicio", "todos los derechos reservados",
)
BOILERPLATE_MAX_WORDS = 12
# A document goes if the lines removed hold more than this percentage of its words.
MAX_LOST_PCT = 50

# The same patterns for the worker and for SQL.
BAR = r"^[|¦·•»›→/>~]+$"
MARKED = r"[#*$%&<>!]{2}"

_BAR, _MARKED = re.compile(BAR), re.compile(MARKED)
# str.split() also splits at other white space, so split bytes: six ASCII characters only
_TO_SPACE = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})


def words_of(text: str) -> list[str]:
    """Words: runs of anything but the six ASCII white space characters."""
    return [w for w in text.translate(_TO_SPACE).split(" ") if w]


def line_fails(words: list[str], line: str) -> bool:
    """Verdict of the line rules on a line with at least one word.

    Navigation: more than MAX_BARS_PCT percent of its words are separators of menus or breadcrumbs. Punctuation: more than
    MAX_MARKED_PCT percent carry a run of marks, or more than MAX_SAME_PCT percent repeat the
    word before. Boilerplate: a short line with a fixed phrase.
    """
    n = len(words)
    if 100 * sum(map(bool, map(_BAR.search, words))) > MAX_BARS_PCT * n:
        return True
    if _MARKED.search(line) and 100 * sum(map(bool, map(_MARKED.search, words))) > MAX_MARKED_PCT * n:
        return True
    if n >= SAME_FROM_WORDS and \
            100 * sum(a == b for a, b in zip(words, words[1:])) > MAX_SAME_PCT * n:
        return True
    if n <= BOILERPLATE_MAX_WORDS:
        low = line.encode().lower()  # A-Z only
        return any(p.encode() in low for p in BOILERPLATE)
    return False


def clean_lines(text: str) -> tuple[list[str], int, int, int]:
    """(kept lines, words, words removed, lines equal to an earlier one) of a whole text.

    Lines without a word are kept as they are.
    """
    kept, n, lost, same, seen = [], 0, 0, 0, set()
    for line in text.split("\n"):
        words = words_of(line)
        if words:
            n += len(words)
            same += line in seen
            seen.add(line)
            if line_fails(words, line):
                lost += len(words)
                continue
        kept.append(line)
    return kept, n, lost, same


def repeated_words(words: list[str]) -> int:
    """Words inside a window of three words that stands twice or more in the list."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    m = len(number)
    pairs = np.unique(ids[:-1] * m + ids[1:], return_inverse=True)[1]
    windows = pairs[:-1].astype(np.int64) * m + ids[2:]
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k:n - 2 + k] |= again
    return int(hit.sum())


def judge(text: str) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    _, n, lost, same = clean_lines(text)
    words = words_of(text)
    repeated = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEATED_PCT * n
    return (n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), same, repeated, failed,
            not failed and 100 * lost <= MAX_LOST_PCT * n)


FIELDS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"),
          ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"),
          ("kept", "boolean")]


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept).

    Every line is judged first; a document is rejected if it has too few words, mostly
    repeats itself, or loses more than half of its words with the failing lines.

    Null text counts as empty: no words, base_failed. Null ids and repeated rows are kept, one
    row out per row in; a very long text is one row of one task. Further columns are not read.
    """
    return map_texts(docs, text_col, [id_col], lambda: judge, FIELDS)


def cleaned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that are kept, all columns as they are, the text without its failing lines.

    Taking lines out may leave fewer than MIN_WORDS words; the verdict on the whole text holds. Null and
    empty texts have too few words and go. Repeated rows and null ids are judged each for itself; an empty
    table stays empty; a very long text is one row of one task. Columns of any other name pass through.
    """
    at, target = docs.columns.index(text_col), arrow_schema(docs.schema)

    def run(batches):
        for b in sliced(batches):
            texts = [t or "" for t in b.column(at).to_pylist()]
            keep = [judge(t)[-1] for t in texts]
            arrays = [b.column(i).cast(target.field(i).type) for i in range(b.num_columns)]
            arrays[at] = pa.array(["\n".join(clean_lines(t)[0]) if k else t
                                   for t, k in zip(texts, keep)], target.field(at).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=target).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
