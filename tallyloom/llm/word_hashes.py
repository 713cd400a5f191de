"""64-bit hashes of the words of many texts at once, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes that are hashed in one go; longer texts are cut behind white space.
SEGMENT = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
# a random number for each byte, the same for A-Z and a-z
_BYTE = np.random.Generator(np.random.PCG64(20240501)).integers(0, 1 << 64, 256, np.uint64, False)
_BYTE[65:91] = _BYTE[97:123]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the outcome depends on all bits of ``h``."""
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


class WordHashes:
    """Hash of each word (a run of anything but ASCII white space, A-Z folded), by text.

    A word's hash is a polynomial of its bytes modulo 2⁶⁴, taken as the difference of two running
    sums, so a whole segment of text is a few vector operations.
    """

    def __init__(self):
        self.powers = _powers(_BASE, SEGMENT + 1)
        self.inverse = _powers(_INVERSE, SEGMENT + 1)

    def _segment(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start of each word, its hash)"""
        if len(data) > len(self.powers):
            self.powers = _powers(_BASE, len(data))
            self.inverse = _powers(_INVERSE, len(data))
        word = ~_SPACE[data]
        edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        start, end = edge[::2], edge[1::2]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * self.powers[:len(data)], out=sums[1:])
        return start, mixed((sums[end] - sums[start]) * self.inverse[start])

    def of_bytes(self, data: np.ndarray) -> np.ndarray:
        """Hashes of one text's words in order."""
        if len(data) <= SEGMENT:
            return self._segment(data)[1]
        out, at = [], 0
        while at < len(data):
            end = min(at + SEGMENT, len(data))
            while end < len(data) and not _SPACE[data[end - 1]]:
                rest = np.flatnonzero(_SPACE[data[end:end + SEGMENT]])
                end = end + int(rest[0]) + 1 if len(rest) else min(end + SEGMENT, len(data))
            out.append(self._segment(data[at:end])[1])
            at = end
        return np.concatenate(out)

    def of_texts(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Hashes of the words of each text of an Arrow string column; null texts have none."""
        if not isinstance(texts, pa.LargeStringArray):
            texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        held = texts.buffers()[2]
        data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
        valid = texts.is_valid().to_numpy(zero_copy_only=False)
        i = 0
        while i < len(texts):
            # as many texts as fit a segment, with the gap between two of them counted as white space
            j = int(np.searchsorted(offsets, offsets[i] + SEGMENT // 2, side="right")) - 1
            if j <= i + 1:
                own = data[offsets[i]:offsets[i + 1]] if valid[i] else data[:0]
                yield self.of_bytes(own)
                i += 1
                continue
            gaps = offsets[i + 1:j] - offsets[i]
            start, hashes = self._segment(np.insert(data[offsets[i]:offsets[j]], gaps, 32))
            cuts = np.searchsorted(start, gaps + np.arange(1, len(gaps) + 1))
            for k, own in enumerate(np.split(hashes, cuts)):
                yield own if valid[i + k] else own[:0]
            i = j


def words_of(text: str) -> list[bytes]:
    """The words themselves, for tests and for exact checks."""
    return text.encode().lower().split()
