"""FNV-1a shingles, seeded MinHash and band hashes, bit for bit, as numpy steps over whole Arrow columns.

The portable family of kindred.functions.text can be checked with SQL; this one is for signatures that must equal those
of other programs. A shingle is the FNV-1a hash (64 bits) of n tokens, each as its kind in four bytes, highest first, and
its text in UTF-8. Hashes are unsigned; columns hold their bits in a signed long.
"""

from __future__ import annotations

import numpy as np

# Fixed values.
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
MIX = (0xCC9E2D51, 0x1B873593, 5, 0xE6546B64)
EMPTY = 2**32 - 1
#: The kind of a token that comes without one: a name.
NAME = 4


def fnv1a(data: bytes, h: int = FNV_START) -> int:
    for b in data:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def shingle_hashes(tokens: list[str], kinds: list[int] | None, n: int, known: dict) -> list[int]:
    """Distinct hashes of n tokens in a row, as signed longs; none for fewer tokens. known: hashes found before."""
    raw = [(k & 0xFFFFFFFF).to_bytes(4, "big") + t.encode() for k, t in zip(kinds or [NAME] * len(tokens), tokens, strict=True)]
    out = {}
    for i in range(len(raw) - n + 1):
        run = b"".join(raw[i : i + n])
        if (h := known.get(run)) is None:
            h = fnv1a(run)
            h = known[run] = h - (1 << 64) if h >> 63 else h
        out[h] = None
    return list(out)


def mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """One round of a seeded mixer over the folded halves of 64-bit hashes."""
    first, second, times, more = (np.uint32(x) for x in MIX)
    x = h.astype(np.uint32) ^ (h >> np.uint64(32)).astype(np.uint32) ^ np.uint32(seed)
    x = x * first
    x = (x << np.uint32(15) | x >> np.uint32(17)) * second ^ np.uint32(seed)
    return (x << np.uint32(13) | x >> np.uint32(19)) * times + more


def minima(shingles: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """(rows, k) least mixed hashes of rows that hold shingles[bounds[i]:bounds[i + 1]]; all ones for an empty row."""
    h, out = shingles.astype(np.int64).view(np.uint64), np.full((len(bounds) - 1, k), EMPTY, np.uint32)
    has = np.diff(bounds) > 0
    if has.any():
        for i in range(k):
            out[has, i] = np.minimum.reduceat(mixed(h, i), bounds[:-1][has])
    return out


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(rows, bands) FNV-1a hashes of each band's minima, each in four bytes, highest first.

    A band beyond the signature's end hashes what is left of it, so nothing at all hashes alike everywhere.
    """
    raw = np.ascontiguousarray(sig.astype(">u4")).view(np.uint8).reshape(len(sig), -1)
    out = np.full((len(sig), bands), FNV_START, np.uint64)
    for b in range(bands):
        for column in raw[:, 4 * b * rows : 4 * (b + 1) * rows].T:
            out[:, b] = (out[:, b] ^ column.astype(np.uint64)) * np.uint64(FNV_PRIME)
    return out.view(np.int64)
