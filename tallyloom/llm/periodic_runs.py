"""Periodic runs of words, found by internal pattern matching.

Blocks of 8, 16, 32, … words stand at multiples of their length. Where a block occurs again within the
next two block lengths is asked of a wavelet matrix over the suffix array: the successor of a position
among the suffixes that begin with the block. Occurrences close together form a progression; they and
the ends of the stretches around them give candidate periods, and a candidate is a run if the stretch
that keeps its period is long enough. A run of period q (three periods or more) holds a block of the
largest power of two up to q together with its copy one period on, so no run is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.common import arrow_schema, as_schema, sliced

MIN_WORDS = 24
MIN_PERIODS = 3
# Shortest block; a run of the least length holds one with its copy for every shorter period.
BLOCK = 8
# Words that are indexed together; a longer text is indexed alone.
BATCH_WORDS = 1 << 18

OUTPUT = ("n_words", "runs", "collapsed")


def words_of(text: str) -> list[bytes]:
    """Runs of anything but ASCII white space, as UTF-8."""
    return text.encode().split()


class Stretches:
    """Equal stretches of 1, 2, 4, … words of a sequence, and its suffix array.

    ``codes`` are word numbers from 0 in which the last occurs once. Places with equal numbers in
    ``levels[k]`` begin with the same 2^k words; the number is the first row of theirs in the suffix array.
    """

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        counts = np.bincount(codes)
        rank = (np.cumsum(counts) - counts)[codes]
        size = counts[codes]
        self.levels = [rank.astype(np.int32)]
        # (place, block length, first and end row of its suffixes) of the blocks that occur again
        self.blocks: list[tuple[np.ndarray, int, np.ndarray, np.ndarray]] = []
        active = np.flatnonzero(size > 1)
        length = 1
        while len(active):
            key = rank[active] * n + rank[active + length]
            order = np.argsort(key, kind="stable")
            at, key = active[order], key[order]
            old = rank[at]
            index = np.arange(len(at))
            fresh = np.concatenate([[True], key[1:] != key[:-1]])
            group = np.concatenate([[True], old[1:] != old[:-1]])
            first = np.flatnonzero(fresh)
            begin = np.maximum.accumulate(np.where(group, index, 0))
            sizes = np.diff(np.append(first, len(at)))
            rank = rank.copy()
            rank[at] = old + np.repeat(first, sizes) - begin
            size = np.zeros(n, np.int64)
            size[at] = np.repeat(sizes, sizes)
            length *= 2
            active = np.sort(at[size[at] > 1])
            self.levels.append(rank.astype(np.int32))
            if length >= BLOCK:
                place = active[active % length == 0]
                if len(place):
                    self.blocks.append((place, length, rank[place], rank[place] + size[place]))
        self.suffixes = np.empty(n, np.int64)
        self.suffixes[rank] = np.arange(n)

    def ahead(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Number of equal words from x and from y on; x < y."""
        out = np.zeros(len(x), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            out += (level[x + out] == level[y + out]).astype(np.int64) << k
        return out

    def behind(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Number of equal words before x and before y; x < y."""
        out = np.zeros(len(x), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            i, j = x - out - (1 << k), y - out - (1 << k)
            out += ((i >= 0) & (level[np.maximum(i, 0)] == level[np.maximum(j, 0)])).astype(np.int64) << k
        return out


class WaveletMatrix:
    """Range successor over a permutation of 0 … n−1, many questions at once."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.planes = []
        for bit in range(max(1, self.n.bit_length()) - 1, -1, -1):
            zero = (values >> bit) & 1 == 0
            before = np.zeros(self.n + 1, np.int32)
            np.cumsum(zero, out=before[1:])
            self.planes.append((bit, before, int(before[-1])))
            values = np.concatenate([values[zero], values[~zero]])

    def _below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many of the values in rows lo … hi−1 are less than x."""
        out = np.zeros(len(x), np.int64)
        for bit, before, zeros in self.planes:
            one = (x >> bit) & 1 == 1
            lo0, hi0 = before[lo], before[hi]
            out += np.where(one, hi0 - lo0, 0)
            lo = np.where(one, zeros + lo - lo0, lo0)
            hi = np.where(one, zeros + hi - hi0, hi0)
        return out

    def _nth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value, from 0, in rows lo … hi−1."""
        out = np.zeros(len(k), np.int64)
        for bit, before, zeros in self.planes:
            lo0, hi0 = before[lo], before[hi]
            one = k >= hi0 - lo0
            k = np.where(one, k - (hi0 - lo0), k)
            lo = np.where(one, zeros + lo - lo0, lo0)
            hi = np.where(one, zeros + hi - hi0, hi0)
            out |= one.astype(np.int64) << bit
        return out

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The smallest value from x on in rows lo … hi−1, n if there is none."""
        out = np.full(len(x), self.n, np.int64)
        k = self._below(lo, hi, np.minimum(x, self.n - 1))
        some = np.flatnonzero((k < hi - lo) & (x < self.n))
        out[some] = self._nth(lo[some], hi[some], k[some])
        return out


def _candidates(s: Stretches, tree: WaveletMatrix) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of every candidate."""
    places, periods = [], []
    for place, length, lo, hi in s.blocks:
        home, at = place, place
        while len(home):
            # the next occurrence of each block, up to two lengths behind its home
            got = tree.successor(lo, hi, at + 1)
            near = got < np.minimum(home + 2 * length, tree.n)
            home, at, got, lo, hi = home[near], at[near], got[near], lo[near], hi[near]
            places.append(home)
            periods.append(got - home)
            step = got - at
            # close together: a progression, inside a stretch of that period
            many = np.flatnonzero(2 * step <= length)
            here, d, own = at[many], step[many], home[many]
            end = here + d + s.ahead(here, here + d)
            begin = here - s.behind(here, here + d)
            own_end = own + d + s.ahead(own, own + d)
            own_begin = own - s.behind(own, own + d)
            for other, mine in ((end, own_end), (begin, own_begin)):
                far = (other > mine) & (other - mine < 2 * length)
                places.append(own[far])
                periods.append((other - mine)[far])
            at = got
            at[many] = here + (end - length - here) // d * d  # its last occurrence
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(periods)


def runs_of(texts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of every run of several sequences of word numbers.

    The numbers of two sequences have to differ. Ordered by text, start and period.
    """
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes + 1) - sizes - 1
    top = max((int(t.max()) for t in texts if len(t)), default=-1) + 1
    codes = np.concatenate([np.append(t, top + i) for i, t in enumerate(texts)])
    s = Stretches(codes)
    if not s.blocks:
        return (np.zeros(0, np.int64),) * 4
    place, period = _candidates(s, WaveletMatrix(s.suffixes))
    both = np.unique(place * len(codes) + period)
    place, period = both // len(codes), both % len(codes)
    start = place - s.behind(place, place + period)
    length = place + period + s.ahead(place, place + period) - start
    good = length >= np.maximum(MIN_WORDS, MIN_PERIODS * period)
    start, length, period = start[good], length[good], period[good]
    # the same stretch under a multiple of its period: the least one counts
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    same = (start[1:] == start[:-1]) & (length[1:] == length[:-1])
    least = np.concatenate([[True], ~same]) if len(start) else np.zeros(0, bool)
    start, length, period = start[least], length[least], period[least]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    text = np.searchsorted(starts, start, side="right") - 1
    return text, start - starts[text], length, period


def _batches(texts: list[list[bytes]]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Numbered words of the texts long enough, as many at a time as are indexed together."""
    rows: list[int] = []
    codes: list[np.ndarray] = []
    base = held = 0
    for i, words in enumerate(texts):
        if len(words) < MIN_WORDS:
            continue
        if rows and held + len(words) > BATCH_WORDS:
            yield rows, codes
            rows, codes, base, held = [], [], 0, 0
        number: dict[bytes, int] = {}
        own = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        rows.append(i)
        codes.append(own + base)
        base += len(number)
        held += len(words)
    if rows:
        yield rows, codes


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words joined by a space, without what any run holds after its first period."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep)]).decode()


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed), one row per document.

    ``runs`` lists (start, length, period) by start and period: the longest stretches of words that keep
    their smallest period q, with at least 24 words and three periods; places count words from 0.
    ``collapsed`` holds the words joined by one space, without those that some run holds after its first
    period.

    Null, empty and blank texts have no words, no runs and an empty ``collapsed``. Runs that overlap or lie
    inside each other are all listed. Texts are indexed whole; one of n words takes about 4 n log₂ r
    bytes, r being its longest repeat, and n log₂ n for the wavelet matrix. Repeated rows and null ids
    come out as they came in; an empty table gives none. Other columns are not read; an id column may not
    have the name of an output column.
    """
    if id_col in OUTPUT:
        raise ValueError(f"the id column may not be called {id_col}")
    schema = as_schema([("id", docs.schema[id_col].dataType.simpleString()), ("n_words", "long"),
                        ("runs", "array<struct<start:bigint,length:bigint,period:bigint>>"),
                        ("collapsed", "string")])
    target = arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = [words_of(t or "") for t in b.column(1).to_pylist()]
            found: list[list] = [[] for _ in texts]
            for rows, codes in _batches(texts):
                for i, *run in zip(*(a.tolist() for a in runs_of(codes))):
                    found[rows[i]].append(tuple(run))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(target.field(0).type), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([[dict(zip(("start", "length", "period"), r)) for r in f] for f in found],
                          target.field(2).type),
                 pa.array([collapse(t, f) if f else b" ".join(t).decode() for t, f in zip(texts, found)],
                          pa.string())],
                schema=target)

    return docs.select(F.col(f"`{id_col}`").alias("id"), f"`{text_col}`").mapInArrow(work, schema) \
        .withColumnRenamed("id", id_col)
