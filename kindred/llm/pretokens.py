"""Pre-tokens of public BPE tokenizers, found over whole arrays of code points.

Both patterns treat letters, numbers, white space and the rest as runs:

    SPACE_FIRST  's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    WORDS_ONLY   's|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+      (white space dropped)

so a pre-token's ends follow from where the class of a character changes. The classes are asked of the tokenizers
library's own pattern engine, once in a process.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
from tokenizers import Regex, pre_tokenizers

from kindred.functions.words import _BASE, _BASE_INV, _table, mix

OTHER, LETTER, NUMBER, SPACE = range(4)
_CODE = np.random.default_rng(77).integers(1, 2**63, 1 << 12, dtype=np.uint64)
_ENDINGS = {"s": 1, "t": 1, "m": 1, "d": 1, "re": 2, "ve": 2, "ll": 2}
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


_UNKNOWN = 255
_classes = np.full(0x110000, _UNKNOWN, np.uint8)


def classes(codes: np.ndarray) -> np.ndarray:
    """The class of each code point; those not met before are asked of the library."""
    out = _classes[codes]
    if (out == _UNKNOWN).any():
        new = np.unique(codes[out == _UNKNOWN])
        _classes[new] = OTHER
        text = new.astype("<u4").tobytes().decode("utf-32-le")
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
                _classes[new[a:b]] = kind
        out = _classes[codes]
    return out


@cache
def lower_codes() -> np.ndarray:
    """The lower case of each code point that has one of one code point."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x1F000):  # no letter beyond has cases
        if len(x := chr(c).lower()) == 1:
            out[c] = ord(x)
    return out


def _rows(data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(data.decode().encode("utf-32-le"), "<u4")
    if len(codes) == len(data):
        return codes, bounds
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80, out=heads[1:])
    return codes, heads[bounds]


def normal_rows(data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of rows in NFC and lower case, and the rows' bounds."""
    text = data.decode()
    if "İ" in text or not unicodedata.is_normalized("NFC", text):
        rows = [unicodedata.normalize("NFC", data[a:b].decode()).replace("İ", "i̇").encode() for a, b in zip(bounds, bounds[1:])]
        data, bounds = b"".join(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    codes, bounds = _rows(data, bounds)
    return lower_codes()[codes].astype("<u4"), bounds


class PreTokens:
    """Pre-token i: codes[start[i]:end[i]]; row r has pre-tokens first[r] to first[r + 1]."""

    def __init__(self, codes: np.ndarray, bounds: np.ndarray, space_first: bool):
        global _pow, _inv
        self.codes, n = codes, len(codes)
        kind = classes(codes)
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True  # where a row begins or all end
        new = edge.copy()
        if n:
            new[1:n] |= kind[1:] != kind[:-1]
        begins = new[:n].copy()
        runs = np.flatnonzero(begins)
        ends = np.append(runs[1:], n)[: len(runs)]
        what = kind[runs] if n else np.zeros(0, np.uint8)
        glued = np.zeros(n, bool)
        if space_first:
            led = runs[(what != SPACE) & ~edge[runs]]
            led = led[codes[led - 1] == 32]
            begins[led] = False
            glued[led] = True
            gap = (what == SPACE) & ~edge[ends] if len(runs) else np.zeros(0, bool)
            begins[ends[gap] - 1] = True
        else:
            begins |= kind == NUMBER
        quote = runs[(what == OTHER) & (ends - runs == 1) & ~edge[ends] if len(runs) else np.zeros(0, bool)]
        quote = quote[(codes[quote] == 39) & ~glued[quote]]
        for q in quote[kind[quote + 1] == LETTER].tolist():
            one = chr(codes[q + 1])
            m = _ENDINGS.get(one) or (q + 2 < n and not edge[q + 2] and _ENDINGS.get(one + chr(codes[q + 2]))) or 0
            if m:
                begins[q + 1] = False
                after = q + 1 + m
                if after < n and not edge[after] and kind[after] == LETTER:
                    begins[after] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], n)[: len(start)]
        if not space_first:
            words = kind[start] != SPACE
            start, end = start[words], end[words]
        self.start, self.end = start, end
        self.first = np.searchsorted(start, bounds)
        _pow, _inv = _table(_pow, _BASE, n + 1), _table(_inv, _BASE_INV, n + 1)
        total = np.zeros(n + 1, np.uint64)
        # a code point's factor is made of two random ones, so that all of them have their own
        value = _CODE[codes & 0xFFF] + _CODE[(codes >> 12) & 0xFFF] * np.uint64(0x9E3779B1)
        np.cumsum(value * _pow[:n], out=total[1:])
        self.hash = mix((total[end] - total[start]) * _inv[start])

    def text(self, i: int) -> str:
        return self.codes[self.start[i] : self.end[i]].tobytes().decode("utf-32-le")


def gather(lengths: np.ndarray, begins: np.ndarray, store: np.ndarray) -> np.ndarray:
    """store[begins[i] : begins[i] + lengths[i]] for all i, one after another."""
    total = int(lengths.sum())
    at = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return store[np.repeat(begins, lengths) + at]
