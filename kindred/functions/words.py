"""Words and word n-grams of Arrow string batches, hashed with whole-array numpy steps.

A word's hash is a polynomial over its bytes modulo 2**64, from prefix sums: no Python object is made for a word.
Two different words agree with odds near 2**-64; n-grams can be hashed twice, with independent constants, to 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 19

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_GRAM = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _table(out: np.ndarray, base: int, n: int) -> np.ndarray:
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bytes(separators: bytes) -> np.ndarray:
    """True for each byte that is part of a word."""
    out = np.ones(256, bool)
    out[list(separators)] = False
    return out


#: Words [^\\x20\\x09-\\x0D]+.
SPACED = word_bytes(b" \t\n\x0b\x0c\r")
#: Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+: digits, a to z and all that is not ASCII.
ALNUM = word_bytes(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Words of some rows. word i: bytes data[start[i]:end[i]]; row r has words first[r] to first[r + 1]."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, kind: np.ndarray, lower: bool):
        global _pow, _inv
        self.data = data = _LOWER[data] if lower else data
        n, rows = len(data), len(bounds) - 1
        is_word = np.zeros(n + 2, bool)
        is_word[1:-1] = kind[data]
        begins = is_word[1:] & ~is_word[:-1]
        ends = is_word[:-1] & ~is_word[1:]
        inner = bounds[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        cut = inner[is_word[inner] & is_word[inner + 1]]  # a row ends with a word and the next begins with one
        begins[cut] = ends[cut] = True
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, bounds)
        self.rows, self.at = rows, bounds
        _pow, _inv = _table(_pow, _BASE, n + 1), _table(_inv, _BASE_INV, n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * _pow[:n], out=total[1:])
        self._total = total
        self.hash = mix((total[self.end] - total[self.start]) * _inv[self.start])

    def beginnings(self, at: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the first k bytes of some words, apart from those of whole words and of other lengths."""
        start = self.start[at]
        return mix((self._total[start + k] - self._total[start]) * _inv[start] + np.uint64(k))

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.first))

    def grams(self, k: int, which: int = 0) -> np.ndarray:
        """Hash of the k words from each word on; rows are not told apart (see inside())."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix(poly(self.hash, k, _GRAM[which]))

    def inside(self, k: int) -> np.ndarray:
        """Of the positions of grams(k), which have all k words in one row."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, bool)
        row = self.row_of()
        return row[:n] == row[k - 1 :]


def poly(x: np.ndarray, k: int, c: int) -> np.ndarray:
    """sum of x[i + j] * c**j over j < k, for each i, by doubling."""
    n = len(x) - k + 1
    out, done = None, 0
    power, width = x, 1  # power[i]: the sum over `width` items
    bits = k
    while bits:
        if bits & 1:
            part = power[done : done + n] * np.uint64(pow(c, done, 1 << 64))
            out = part if out is None else out + part
            done += width
        bits >>= 1
        if bits:
            power = power[: len(power) - width] + power[width:] * np.uint64(pow(c, width, 1 << 64))
            width *= 2
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row bounds of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, bounds, data = column.buffers()
    at = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def sliced(column: pa.Array, kind: np.ndarray, lower: bool, most: int = SLICE) -> Iterator[tuple[int, int, Words]]:
    """Rows lo to hi with their words, in slices of about `most` bytes, so that memory doesn't follow the batch."""
    data, at = buffers(column)
    lo, rows = 0, len(at) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi, Words(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], kind, lower)
        lo = hi


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def freed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; before each and after the last, Arrow's pool gives what it holds unused back to the system.

    A worker is used again for later tasks, also while the JVM needs the memory, and the pool would keep its peak.
    """
    for batch in batches:
        pa.default_memory_pool().release_unused()
        yield batch
        del batch
    pa.default_memory_pool().release_unused()
