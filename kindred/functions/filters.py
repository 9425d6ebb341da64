"""Bloom filters of hashes seen once, seen again, and seen often, built by regions of the hash space.

Tasks send each hash of their batch once, with its count, packed by region. Rows come sorted by region; a region's
filters are built as its rows stream by and are sent when it ends, so a task holds one region at a time. Hashes seen
again are fewer than hashes, and those seen often are fewer still, so their filters have a share of the bits. Only the
finished filters asked for are gathered and broadcast, of at most MOST_BITS / AGAIN and MOST_BITS / OFTEN bits, or
MOST_ONCE where the filter of all hashes is asked for. A filter never misses a hash; it takes some for seen that are not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

REGIONS, PROBES = 1024, 4
#: The most bits for all hashes while they are counted (4 MB a region), and of a filter of them that is broadcast.
MOST_BITS, MOST_ONCE = 1 << 32, 1 << 30
#: How many times fewer bits the filters of hashes seen again, and seen often, have.
AGAIN, OFTEN = 4, 16
SCHEMA = "region int, h binary, n binary"
_REGION_BITS, _UNIT = 10, 1 << 18


def bits_for(count: float, each: int, most: int = MOST_BITS) -> int:
    """As many bits for each hash, in whole bytes for each region of each filter."""
    return min(most, max(1, -(-int(count * each) // _UNIT)) * _UNIT)


def _cells(h: np.ndarray, bits: int):
    """A hash's places in its filter, one array for each probe; the lowest 16 bits of the hash play no part."""
    h = h >> np.uint64(16)
    span = np.uint64(bits // REGIONS)
    base = (h >> np.uint64(48 - _REGION_BITS)) * span
    step = (h >> np.uint64(20)) | np.uint64(1)
    for i in range(PROBES):
        yield base + ((h & np.uint64((1 << 48 - _REGION_BITS) - 1)) + step * np.uint64(i)) % span


def has(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.arange(len(h))
    for _, cell in zip(range(PROBES), _cells(h, 8 * len(filter_)), strict=True):
        cell = cell[out]
        out = out[(filter_[cell >> np.uint64(3)] >> (np.uint64(7) - (cell & np.uint64(7))).astype(np.uint8)) & 1 == 1]
    got = np.zeros(len(h), bool)
    got[out] = True
    return got


def packed(h: np.ndarray) -> pa.RecordBatch:
    """Rows of SCHEMA for a batch's hashes."""
    h, n = np.unique(h >> np.uint64(16), return_counts=True)
    cuts = np.searchsorted(h, np.arange(REGIONS + 1, dtype=np.uint64) << np.uint64(48 - _REGION_BITS))
    at = np.flatnonzero(np.diff(cuts))
    planes = h.view(np.uint16).reshape(-1, 4)
    n = np.minimum(n, 255).astype(np.uint8)
    parts = [slice(cuts[i], cuts[i + 1]) for i in at]
    return pa.RecordBatch.from_arrays(
        [pa.array(at.astype(np.int32)), pa.array([np.ascontiguousarray(planes[p, :3].T).tobytes() for p in parts], pa.binary()), pa.array([n[p].tobytes() for p in parts], pa.binary())],
        ["region", "h", "n"],
    )


def _unpacked(b) -> np.ndarray:
    low = np.frombuffer(b, np.uint16).reshape(3, -1).astype(np.uint64)
    return (low[0] | low[1] << np.uint64(16) | low[2] << np.uint64(32)) << np.uint64(16)


class _Region:
    """The filters of one region, as one byte for each bit."""

    def __init__(self, region: int, bits: int, often: int):
        self.region, self.bits, self.often, self.new = region, bits, often, True
        sizes = bits // REGIONS, bits // AGAIN // REGIONS, bits // OFTEN // REGIONS if often else 0
        self.sizes, self.marks = sizes, [np.zeros(n, bool) for n in sizes]
        self.counts = np.zeros(sizes[1] if often else 0, np.uint16)

    def _places(self, h: np.ndarray, which: int) -> list[np.ndarray]:
        size = self.sizes[which]
        return [c.astype(np.int64) - self.region * size for c in _cells(h, size * REGIONS)]

    def add(self, h: np.ndarray, n: np.ndarray) -> None:
        cells, old = self._places(h, 0), n > 1
        if not self.new:
            old = old | np.logical_and.reduce([self.marks[0][c] for c in cells])
        self.new = False
        for c in cells:
            self.marks[0][c] = True
        h, n = h[old], n[old]
        cells = self._places(h, 1)
        for c in cells:
            self.marks[1][c] = True
        if self.often:
            for c in cells[:2]:
                self.counts[c] = np.minimum(self.counts[c].astype(np.int64) + n, 60_000)
            many = np.minimum(*(self.counts[c] for c in cells[:2])) >= self.often
            for c in self._places(h[many], 2):
                self.marks[2][c] = True

    def row(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([self.region], pa.int32()), *(pa.array([np.packbits(x).tobytes()]) for x in self.marks)], ["region", "once", "twice", "many"])


def _builder(bits: int, often: int):
    """Rows come sorted by region."""

    def run(batches):
        now = None
        for batch in batches:
            for r, h, n in zip(*batch.columns, strict=True):
                if now is None or now.region != r.as_py():
                    if now:
                        yield now.row()
                    now = _Region(r.as_py(), bits, often)
                now.add(_unpacked(h.as_buffer()), np.frombuffer(n.as_buffer(), np.uint8))
        if now:
            yield now.row()

    return run


def build(rows: DataFrame, bits: int, once: bool = False, again: bool = True, often: int = 0) -> list[np.ndarray]:
    """The filters asked for, of: seen at all (once), seen again, seen about `often` times or more."""
    wanted = [("once", 1)] * once + [("twice", AGAIN)] * again + [("many", OFTEN)] * bool(often)
    out = [np.zeros(bits // d // 8, np.uint8) for _, d in wanted]
    built = rows.repartition("region").sortWithinPartitions("region").mapInArrow(_builder(bits, often), "region int, once binary, twice binary, many binary")
    for r in built.select("region", *(w for w, _ in wanted)).toLocalIterator():
        for whole, (name, _) in zip(out, wanted, strict=True):
            size = len(whole) // REGIONS
            whole[r.region * size : (r.region + 1) * size] = np.frombuffer(r[name], np.uint8)
    return out
