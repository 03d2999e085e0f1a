"""Words, lines and shingles of a column of texts as numpy arrays.

A column's UTF-8 bytes are scanned as one array: no Python object is made for a word.
A word or line is known by a 64-bit polynomial hash of its bytes (random value per
byte, odd base), finished by a bijective mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD1342543DE82EF95)
_BLOCK = 1 << 20

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PLAIN = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWERED = _PLAIN.copy()
_LOWERED[65:91] = _PLAIN[97:123]

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def release() -> None:
    """Let go the tables of powers."""
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            table = np.full(max(n, _BLOCK * 2), base, np.uint64)
            table[0] = 1
            _powers[i] = np.cumprod(table)
    return _powers


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hash of each span ``data[start:end]``; spans in order and apart. ``lower``: A-Z as a-z."""
    out = np.empty(len(starts), np.uint64)
    values = _LOWERED if lower else _PLAIN
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, lo + _BLOCK)))
        hi = int(ends[j - 1])
        up, down = _power_tables(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(values[data[lo:hi]] * up[: hi - lo], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins and the last ends; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(at) == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


def batches(source: Iterator[pa.RecordBatch], text_col: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at least one row and, beyond that, at most ``most`` bytes of text."""
    for batch in source:
        size = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False).cumsum()
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + most, "right")))
            yield batch.slice(i, j - i)
            i = j


class Words:
    """Words of a column: byte spans, the row of each word, first word of each row, hashes."""

    def __init__(self, column: pa.Array, lower: bool) -> None:
        data, at = flat(column)
        n = len(data)
        self.data, self.rows = data, len(at) - 1
        inside = ~_IS_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        begin, finish = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1] | edge[1:n]
        finish[:-1] &= ~inside[1:] | edge[1:n]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.starts, at)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(self.rows), self.counts)
        self.hash = span_hashes(data, self.starts, self.ends, lower)

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """Sum over the words of each row."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.first[1:]] - total[self.first[:-1]]


def window_hashes(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``n`` words of one row, and the index of its first word."""
    count = len(words.hash) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(words.row[:count] == words.row[n - 1 :])
    total = np.full(len(at), n, np.uint64)
    for k in range(n):
        total = total * _STEP + words.hash[at + k]
    return mix(total), at


def shingle_sets(words: Words, n: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its runs of ``n`` words; fewer words: the whole sequence as one."""
    hashes, at = window_hashes(words, n)
    edge = np.searchsorted(at, words.first)
    sets = [np.unique(hashes[edge[i] : edge[i + 1]]) for i in range(words.rows)]
    for i in np.flatnonzero((words.counts > 0) & (words.counts < n)):
        total = np.array([words.counts[i]], np.uint64)
        for h in words.hash[words.first[i] : words.first[i + 1]]:
            total = total * _STEP + h
        sets[i] = mix(total)
    return sets
