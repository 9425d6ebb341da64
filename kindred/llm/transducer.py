"""A minimal acyclic transducer: a shared-suffix automaton of words that gives each word's ids.

Words are added in byte order (Daciuk et al., 2000): what is left of the last word is minimized as the next one
branches off, so the automaton is minimal at any time. An edge carries the number of words that sort before those
behind it; their sum along a word is the word's rank, which finds its ids. The compiled form is one block of bytes of
plain arrays. A process maps it into memory once, and walks all words of a batch at the same time, a byte a step.
"""

from __future__ import annotations

import mmap
import os
import struct

import numpy as np

_HEAD = "<6q"


def compile_words(words: list[bytes], ids: list[list[int]]) -> bytes:
    """words: distinct, in byte order, not empty."""
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    known: dict[tuple, int] = {}

    def freeze(node) -> int:
        key = (node[0], tuple((c, t) for c, t in node[1]))
        if (at := known.get(key)) is None:
            at = known[key] = len(states)
            states.append(key)
        return at

    path: list[list] = [[False, []]]  # nodes not yet frozen; an edge's target is filled in as it is
    last = b""
    for word in words:
        if last and word <= last:
            raise ValueError("words must be distinct and in byte order")
        same = len(os.path.commonprefix([word, last]))
        while len(path) > same + 1:
            done = freeze(path.pop())
            path[-1][1].append((last[len(path) - 1], done))
        path += [[False, []] for _ in word[same:]]
        path[-1][0] = True
        last = word
    while len(path) > 1:
        done = freeze(path.pop())
        path[-1][1].append((last[len(path) - 1], done))
    root = freeze(path[0])

    behind = np.zeros(len(states), np.int64)  # words that end at or behind a state; targets come before their sources
    keys, targets, skips = [], [], []
    for i, (final, edges) in enumerate(states):
        n = int(final)
        for c, t in edges:
            keys.append(i * 256 + c)
            targets.append(t)
            skips.append(n)
            n += behind[t]
        behind[i] = n
    lengths = np.array([len(x) for x in ids], np.int32)
    flat = np.array([i for x in ids for i in x], np.int32)
    arrays = [np.array(keys, np.int64), np.array(targets, np.int32), np.array(skips, np.int32), np.array([f for f, _ in states], np.uint8), lengths, flat]
    return struct.pack(_HEAD, root, len(keys), len(states), len(words), len(flat), 0) + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """The compiled form, mapped into memory."""

    def __init__(self, compiled: bytes):
        size = max(1, len(compiled))
        try:
            held = os.memfd_create("lexicon")  # memory only: no file in a machine's own folders
            os.ftruncate(held, size)
            self.map = mmap.mmap(held, size)
            os.close(held)
        except (AttributeError, OSError):
            self.map = mmap.mmap(-1, size)
        self.map[:] = compiled
        self.root, edges, states, words, flat, _ = struct.unpack_from(_HEAD, self.map)
        at, out = struct.calcsize(_HEAD), []
        for kind, n in ((np.int64, edges), (np.int32, edges), (np.int32, edges), (np.uint8, states), (np.int32, words), (np.int32, flat)):
            out.append(np.frombuffer(self.map, kind, n, at))
            at += out[-1].nbytes
        self.keys, self.targets, self.skips, self.final, self.lengths, self.ids = out
        self.begins = np.cumsum(self.lengths) - self.lengths

    def ranks(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The rank of each word data[start:end], or -1 of one that isn't in the lexicon."""
        out = np.full(len(start), -1, np.int64)
        if not len(self.keys):
            return out
        at = np.flatnonzero(end > start)
        state, rank, place = np.full(len(at), self.root, np.int64), np.zeros(len(at), np.int64), start[at].astype(np.int64)
        while len(at):
            key = state * 256 + data[place]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[edge] == key
            at, edge, place = at[ok], edge[ok], place[ok] + 1
            state, rank = self.targets[edge].astype(np.int64), rank[ok] + self.skips[edge]
            over = place == end[at]
            good = over & (self.final[state] == 1)
            out[at[good]] = rank[good]
            more = ~over
            at, state, rank, place = at[more], state[more], rank[more], place[more]
        return out
