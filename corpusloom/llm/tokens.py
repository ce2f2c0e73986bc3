"""Words and word windows of many texts at once, as arrays over their UTF-8 bytes.

All separators in use are ASCII, so a word never begins or ends inside a character. Texts of a
column lie in one buffer; nothing here loops over rows or words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Bytes that are part of a word, for the two kinds of words in use.
BLANKS = [9, 10, 11, 12, 13, 32]
SPACED = np.ones(256, bool)
SPACED[BLANKS] = False
# Digits, letters a to z and everything beyond ASCII (after lower-casing).
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)
_SLICE = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finishing steps of a common hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """Words of consecutive texts.

    hash: one value per word; start, end: its bytes in data; first: the number of the first
    word of each text, and at the end the number of words; at: where each text begins in data.
    """

    data: np.ndarray
    at: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column, and where each begins (and the last ends). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    _, places, data = column.buffers()
    at = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]] if len(at) else whole[:0], at - (at[0] if len(at) else 0)


def words_of(column: pa.Array, kind: np.ndarray = SPACED, lower: bool = False) -> Words:
    """Split every text of a column into words; with lower, A to Z count as a to z."""
    data, at = buffer_of(column)
    if lower:
        data = LOWER[data]
    inside = kind[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = np.unique(at[1:-1])
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, at, span_hash(data, start, end), start, end, np.searchsorted(start, at))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.uint64)
    if not len(start):
        return out
    length = end - start
    powers = _powers(_BASE, int(length.max()))
    total = np.cumsum(length)
    low = 0
    while low < len(start):
        before = total[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(total, before + _SLICE, "right")))
        size = length[low:high]
        offset = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(offset, size)
        values = _BYTE[data[np.repeat(start[low:high], size) + place]] * powers[place]
        out[low:high] = np.add.reduceat(values, offset)
        low = high
    return mix(out + length.astype(np.uint64))


def windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of k words inside one text, and the word it begins with."""
    n = len(words.hash)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    last = np.repeat(words.first[1:], words.counts)
    begin = np.flatnonzero(np.arange(n) + k <= last)
    value = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        value = value * _STEP + words.hash[j : n - k + 1 + j]
    return mix(value[begin]), begin


def by_bytes(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each has at most `most` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = buffer_of(batch.column(column))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1)
            yield batch.slice(low, high - low)
            low = high


def spans_covered(begin: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of k words that begins at one of the given words."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, np.minimum(begin + k, n), -1)
    return np.cumsum(change[:-1]) > 0


def texts_kept(words: Words, keep: np.ndarray) -> list[bytes]:
    """The kept words of each text, joined by one space."""
    data = words.data.tobytes()
    out = []
    for low, high in zip(words.first[:-1], words.first[1:]):
        own = np.flatnonzero(keep[low:high]) + low
        out.append(b" ".join([data[a:b] for a, b in zip(words.start[own].tolist(), words.end[own].tolist())]))
    return out
