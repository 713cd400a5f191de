"""Benchmark decontamination: a hash set of the test items' word n-grams, sent to all tasks, scanned and verified.

The windows of all items are words numbered by a vocabulary and cut into blocks of bounded size in the shared
folder; every task reads one block after the other and holds one at a time, so what it holds does not grow
with the benchmark, and nothing is shuffled on the documents' side.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.common import Blocks, arrow_schema, as_schema, blocks, field

WINDOW = 10
# Windows of one block; a window is at most WINDOW words.
BLOCK_WINDOWS = 200_000

# Words of UTF-8 bytes with A-Z lowered: runs of letters, digits and anything beyond ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().lower())


def item_windows(
    benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW
) -> DataFrame:
    """(item, window): distinct windows of each item, words joined by a space.

    An item with fewer words, but not none, is one window; null texts have none.
    """
    schema = as_schema([("item", "string"), ("window", "binary")])

    def run(batches):
        for b in batches:
            items, windows = [], []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words_of(text or "")
                own = {b" ".join(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else ()
                items += [item] * len(own)
                windows += own
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.string()), pa.array(windows, pa.binary())],
                schema=arrow_schema(schema))

    return (benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item"), f"`{text_col}`")
            .mapInArrow(run, schema).distinct())


class Scanner:
    """Occurrences of a block's windows in texts."""

    def __init__(self, windows: list[bytes], items: list):
        self.number: dict[bytes, int] = {}
        self.owners: dict[tuple, list] = defaultdict(list)
        for w, item in zip(windows, items):
            codes = tuple(self.number.setdefault(x, len(self.number) + 1) for x in w.split(b" "))
            self.owners[codes].append(item)
        self.hashes = {}
        for n in {len(c) for c in self.owners}:
            of = np.array([c for c in self.owners if len(c) == n], np.uint64)
            self.hashes[n] = np.unique(self._rolled(of.ravel(), n)[::n])

    @staticmethod
    def _rolled(codes: np.ndarray, n: int) -> np.ndarray:
        """Hash of every window of n codes."""
        out = np.zeros(len(codes) - n + 1, np.uint64)
        for k in range(n):
            out = out * _PRIME + codes[k:len(codes) - n + 1 + k]
            out ^= out >> np.uint64(29)
        return out

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """(mask of words inside an occurrence, owners of the windows that occur)."""
        get = self.number.get
        codes = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        hit = np.zeros(len(words), bool)
        owners: set = set()
        if not codes.any():
            return hit, owners
        known = np.concatenate([[0], np.cumsum(codes > 0)])
        for n, hashes in self.hashes.items():
            if len(codes) < n:
                continue
            whole = np.flatnonzero(known[n:] - known[:-n] == n)  # all n words are in the vocabulary
            if not len(whole):
                continue
            rolled = self._rolled(codes, n)[whole]
            at = np.searchsorted(hashes, rolled)
            found = whole[hashes[np.minimum(at, len(hashes) - 1)] == rolled]
            for i in found.tolist():
                own = self.owners.get(tuple(codes[i:i + n].tolist()))
                if own is not None:  # the words themselves are equal
                    hit[i:i + n] = True
                    owners.update(own)
        return hit, owners


def _spans(hit: np.ndarray) -> list[int]:
    """Start and end word of each run of hits, flat."""
    return np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).tolist()


def _mask(spans: list[int], n: int) -> np.ndarray:
    hit = np.zeros(n, bool)
    for s, e in zip(spans[::2], spans[1::2]):
        hit[s:e] = True
    return hit


def _benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> Blocks:
    return blocks(item_windows(benchmark, id_col, text_col, size), ["window", "item"], BLOCK_WINDOWS)


def _scanner(block: pa.Table) -> Scanner:
    return Scanner(block.column("window").to_pylist(), block.column("item").to_pylist())


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW,
) -> DataFrame:
    """(id, n_words, spans, items) of every document.

    ``spans`` holds start and end (exclusive) of each run of hit words, flat; ``items`` the
    distinct ids, as strings in order, of the test items with a window in the document.

    Null and empty texts have no words and no hits; an empty benchmark hits nothing; an item with
    a null id counts for hits but is not listed. Equal items and repeated rows are all kept, one
    row out per document. Long texts are scanned whole. Further columns are not read; an id column may not
    have the name of an output column.
    """
    if id_col in ("n_words", "spans", "items"):
        raise ValueError(f"the id column may not be called {id_col}")
    schema = as_schema([("_id", field(docs, id_col).dataType.simpleString()), ("n_words", "long"),
                        ("spans", "array<int>"), ("items", "array<string>")])
    target = arrow_schema(schema)
    windows = _benchmark_blocks(benchmark, item_col, item_text_col, size)

    def run(batches):
        kept: dict = {}
        for part in windows.past(batches):
            counts = [[0] * b.num_rows for b in part]
            spans = [[[] for _ in range(b.num_rows)] for b in part]
            items = [[set() for _ in range(b.num_rows)] for b in part]
            for scanner in windows.each(_scanner, kept):
                for k, b in enumerate(part):
                    for i, text in enumerate(b.column(1).to_pylist()):
                        words = words_of(text or "")
                        hit, owners = scanner.scan(words)
                        counts[k][i] = len(words)
                        if owners:
                            spans[k][i] = _spans(hit | _mask(spans[k][i], len(words)))
                            items[k][i].update(o for o in owners if o is not None)
            for k, b in enumerate(part):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).cast(target.field(0).type), pa.array(counts[k], pa.int64()),
                     pa.array(spans[k], target.field(2).type),
                     pa.array([sorted(x) for x in items[k]], target.field(3).type)], schema=target)

    return docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")) \
        .mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def remove_words(text: str, spans: list[int]) -> str:
    """The text without its words in the spans, and without what stands between those of a span."""
    if not spans:
        return text
    places = [m.span() for m in _WORD.finditer(text.encode().lower())]
    data, out, at = text.encode(), [], 0
    for s, e in zip(spans[::2], spans[1::2]):
        out.append(data[at:places[s][0]])
        at = places[e - 1][1]
    return b"".join([*out, data[at:]]).decode()


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", size: int = WINDOW, max_hit_pct: int = 50,
) -> DataFrame:
    """All columns of the documents, hit spans cut out; documents with more than ``max_hit_pct``
    percent of their words hit are removed.

    A cut may bring words together that form a test window again; such windows are cut as well,
    until none is left. All blocks of the benchmark scan the same text before it is cut, and the
    share is judged once, on the words that all cuts took. Null texts stay null, empty ones empty, and an
    empty benchmark changes nothing. Repeated rows and null ids are judged each for itself; a very long text is
    one row of one task; columns of any name pass through.
    """
    windows = _benchmark_blocks(benchmark, item_col, item_text_col, size)
    at, target = docs.columns.index(text_col), arrow_schema(docs.schema)

    def run(batches):
        kept: dict = {}
        for part in windows.past(batches):
            texts = [b.column(at).to_pylist() for b in part]
            lost = [[0] * b.num_rows for b in part]
            total = [[0] * b.num_rows for b in part]
            open_ = [(k, i) for k, b in enumerate(part) for i in range(b.num_rows)]
            first = True
            while open_:
                hits: dict = {}
                for scanner in windows.each(_scanner, kept):
                    for k, i in open_:
                        words = words_of(texts[k][i] or "")
                        if first:
                            total[k][i] = len(words)
                        hit = scanner.scan(words)[0]
                        if hit.any():
                            hits[k, i] = hits[k, i] | hit if (k, i) in hits else hit
                for (k, i), hit in hits.items():
                    lost[k][i] += int(hit.sum())
                    texts[k][i] = remove_words(texts[k][i], _spans(hit))
                open_, first = list(hits), False
            for k, b in enumerate(part):
                arrays = [b.column(c).cast(target.field(c).type) for c in range(b.num_columns)]
                arrays[at] = pa.array(texts[k], target.field(at).type)
                keep = [100 * x <= max_hit_pct * n for x, n in zip(lost[k], total[k])]
                yield pa.RecordBatch.from_arrays(arrays, schema=target).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
