"""Ids of words that a worker has met, by the words' 64-bit hashes, in plain arrays: some 30 bytes for each word."""

from __future__ import annotations

import numpy as np

#: Words kept before all are forgotten, and new ones before they are merged among the others.
MOST, RECENT = 1_000_000, 100_000
_NONE = np.zeros(0, np.uint64), np.zeros(0, np.int32)


class WordMemory:
    """Word number i has the ids store[begins[i] : begins[i] + sizes[i]]."""

    def __init__(self, most: int = MOST):
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.main, self.recent = _NONE, _NONE  # sorted hashes of words, and their numbers
        self.store, self.used, self.words = np.zeros(1 << 16, np.int32), 0, 0
        self.begins, self.sizes = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The numbers of words, -1 for those not met."""
        out = np.full(len(h), -1, np.int64)
        for keys, numbers in (self.main, self.recent):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[at] == h
                out[hit] = numbers[at[hit]]
        return out

    def learn(self, h: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers of new words, whose ids are given one after another."""
        k, many = self.words, len(h)
        while self.used + len(ids) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        while k + many > len(self.sizes):
            self.sizes, self.begins = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sizes, self.begins))
        self.store[self.used : self.used + len(ids)] = ids
        self.sizes[k : k + many] = sizes
        self.begins[k : k + many] = self.used + np.cumsum(sizes) - sizes
        self.used, self.words = self.used + len(ids), k + many
        numbers = np.arange(k, k + many, dtype=np.int32)
        self.recent = _joined(self.recent, (h, numbers))
        if len(self.recent[0]) > RECENT:
            self.main, self.recent = _joined(self.main, self.recent), _NONE
        return numbers

    def numbers(self, h: np.ndarray, make) -> np.ndarray:
        """Numbers of words; make(places) gives the ids and sizes of those not met."""
        if self.words > self.most:
            self.forget()
        out = self.find(h)
        new = np.flatnonzero(out < 0)
        if len(new):
            out[new] = self.learn(h[new], *make(new))
        return out


def _joined(a, b):
    keys = np.concatenate([a[0], b[0]])
    order = np.argsort(keys, kind="stable")
    return keys[order], np.concatenate([a[1], b[1]])[order]
