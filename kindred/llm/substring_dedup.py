"""Exact substring removal with fixed-block anchors.

A window of `window` consecutive words that also starts earlier in the corpus is removed. Every window holds at least
one aligned block of window // 2 words, whatever its phase, so:

1. index: the non-overlapping aligned blocks of every document are grouped by hash; blocks seen once and blocks seen
   again go to two blocked Bloom filters, whose size follows the number of blocks up to a fixed bound;
2. probe: every rolling window of block length is looked up. A position hits if its block is indexed, or for a
   document's own aligned position if it is indexed twice. Both places of a repeat hit, since each one's aligned blocks
   are probed by the other;
3. extend: windows that hold a hit are candidates. Their 96-bit hashes are grouped to find the first place of each, so
   that adjacent repeated windows cover exactly the maximal repeat. False hits of the filters end here.

Cases: null and empty texts have no words; a text shorter than a window loses nothing. Rows with a null doc_id are not
an earlier place for others and lose nothing. Rows that repeat a doc_id are one document's copies: equal texts under
one doc_id keep the same words. Other columns are passed through, whatever their names.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.filters import MOST_ONCE, SCHEMA, bits_for, build, has, packed
from kindred.functions.words import SPACED, buffers, sliced
from kindred.llm.samples import free_names

#: Bits of a filter for each block.
BITS_EACH = 16


def _blocks_of(block: int):
    def run(batches):
        for batch in batches:
            found = []
            for _, _, w in sliced(batch.column(0), SPACED, False):
                h, ok = w.grams(block), w.inside(block)
                at = np.arange(len(h)) - w.first[w.row_of()[: len(h)]]
                found.append(h[ok & (at % block == 0)])
            yield packed(np.concatenate(found or [np.zeros(0, np.uint64)]))

    return run


def _candidates(w, block: int, window: int, once: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Word positions at which a window starts that may also start elsewhere."""
    h = w.grams(block)
    if len(w.hash) < window:
        return np.zeros(0, np.int64)
    at = np.arange(len(h)) - w.first[w.row_of()[: len(h)]]
    hit = has(once, h) & w.inside(block)
    own = np.flatnonzero(hit & (at % block == 0))
    hit[own] = has(twice, h[own])
    before = np.concatenate([[0], np.cumsum(hit)])
    n = len(w.hash) - window + 1
    return np.flatnonzero((before[block : block + n] > before[:n]) & w.inside(window))


def _windows_of(block: int, window: int, parts: int, filters):
    def run(batches):
        once, twice = filters.value
        for batch in batches:
            ids = batch.column(0)
            known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            got = [[], [], [], []]
            for lo, _, w in sliced(batch.column(1), SPACED, False):
                at = _candidates(w, block, window, once, twice)
                row = w.row_of()[at]
                at, row = at[known[lo + row]], row[known[lo + row]]
                hashes = w.grams(window, 0)[at], (w.grams(window, 1)[at] >> np.uint64(32)).astype(np.uint32)
                for x, y in zip(got, (*hashes, ids[lo + row], at - w.first[row]), strict=True):
                    x.append(y)
            if not got[0]:
                continue
            h1, h2, doc, pos = map(np.concatenate, got)
            order, new = _first_places(h1, h2, doc, pos)  # of each window, this batch's first place is enough
            keep = order[new]
            h1, h2, doc, pos = (x[keep] for x in (h1, h2, doc, pos))
            part = (h1 >> np.uint64(32)).astype(np.int64) % parts
            order = np.lexsort((pos, doc, part))
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            out = []
            for i in np.flatnonzero(np.diff(cuts)):
                x = order[cuts[i] : cuts[i + 1]]
                out.append((i, h1[x].tobytes(), h2[x].tobytes(), *_packed(doc[x], pos[x])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32(), *[pa.binary()] * 5], strict=True)] if out else [pa.array([], t) for t in [pa.int32(), *[pa.binary()] * 5]], ["part", "h1", "h2", "docs", "counts", "pos"])

    return run


_PLACES = "part int, h1 binary, h2 binary, docs binary, counts binary, pos binary"


def _first_places(h1, h2, doc, pos) -> tuple[np.ndarray, np.ndarray]:
    """An order by window and place, and where in it a window's first place is."""
    order = np.lexsort((pos, doc, h2, h1))
    a, b = h1[order], h2[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, new


def _planes(x: np.ndarray) -> bytes:
    """The 16-bit parts of all values, lowest parts first, so that empty high parts compress to nothing."""
    return np.ascontiguousarray(x.view(np.uint16).reshape(len(x), -1).T).tobytes()


def _unplaned(b: bytes, kind) -> np.ndarray:
    n = np.dtype(kind).itemsize // 2
    return np.ascontiguousarray(np.frombuffer(b, np.uint16).reshape(n, -1).T).view(kind).ravel()


def _packed(doc: np.ndarray, pos: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Places sorted by document: the documents, the number of places of each, and the positions."""
    at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    return _planes(doc[at]), _planes(np.diff(np.append(at, len(doc))).astype(np.uint32)), _planes(pos.astype(np.uint32))


def _firsts(batches):
    """The first place of each window, as positions by document; rows come sorted by part."""
    held, now = [], None

    def flush():
        h1, h2 = (np.concatenate([np.frombuffer(r[i], t) for r in held]) for i, t in ((1, np.uint64), (2, np.uint32)))
        doc = np.concatenate([np.repeat(_unplaned(r[3], np.int64), _unplaned(r[4], np.uint32)) for r in held])
        pos = np.concatenate([_unplaned(r[5], np.uint32) for r in held])
        order, new = _first_places(h1, h2, doc, pos)
        keep = order[new]
        keep = keep[np.lexsort((pos[keep], doc[keep]))]
        doc, pos = doc[keep], pos[keep].astype(np.int32)
        at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        lists = [x.tobytes() for x in np.split(pos, at[1:])]
        return pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(lists, pa.binary())], ["_id", "pos"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != now and held:
                yield flush()
                held = []
            now = row[0]
            held.append(row)
    if held:
        yield flush()


def _kept_of(block: int, window: int, filters, columns: int, text_at: int, digest: bool):
    """Batches of the input's columns, doc_id and the packed first places; adds n_words, n_removed and the rest."""

    def run(batches):
        once, twice = filters.value
        for batch in batches:
            ids, firsts = batch.column(columns), batch.column(columns + 1)
            data, bounds = buffers(batch.column(text_at))
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            n_words, n_removed, kept = [], [], []
            for lo, hi, w in sliced(batch.column(text_at), SPACED, False):
                at = _candidates(w, block, window, once, twice)
                row = w.row_of()[at]
                late = np.ones(len(at), bool)
                edges = np.searchsorted(row, np.arange(hi - lo + 1))
                for r in range(hi - lo):
                    a, b = edges[r], edges[r + 1]
                    if a < b:
                        first = np.frombuffer(b"".join(firsts[lo + r].as_py() or ()), np.int32)
                        late[a:b] = ~np.isin(at[a:b] - w.first[r], first) & known[lo + r]
                covered = np.zeros(len(w.hash) + 1, np.int64)
                np.add.at(covered, at[late], 1)
                np.add.at(covered, at[late] + window, -1)
                gone = np.cumsum(covered)[:-1] > 0
                for r in range(hi - lo):
                    a, b = w.first[r], w.first[r + 1]
                    words = data[bounds[lo + r] : bounds[lo + r + 1]].tobytes().split()
                    n = int(gone[a:b].sum())
                    text = b" ".join(compress(words, ~gone[a:b]) if n else words)
                    n_words.append(len(words))
                    n_removed.append(n)
                    kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode() if n else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:columns], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                [*(f"c{i}" for i in range(columns)), "n_words", "n_removed", "kept"],
            )

    return run


def substring_dedup(docs: DataFrame, window: int = 20, digest: bool = False) -> DataFrame:
    """docs with three columns more: n_words, n_removed and kept (the words left, joined by a space).

    kept is null where nothing is removed, so that the text stands as it was; with digest, it is the SHA-256 of the
    words left, in any case. The columns are named _n_words, _n_removed and _kept, to leave those of docs alone.
    """
    if window < 2:
        raise ValueError("window must be 2 at least")
    spark, block = docs.sparkSession, window // 2
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = bits_for(size / 5 / block, BITS_EACH, MOST_ONCE)
    filters = spark.sparkContext.broadcast(build(docs.select("text").mapInArrow(_blocks_of(block), SCHEMA), bits, once=True))
    slim, parts = docs.select(F.col("doc_id").cast("long"), "text"), max(64, size >> 24)
    places = slim.mapInArrow(_windows_of(block, window, parts, filters), _PLACES)
    first = places.repartition("part").sortWithinPartitions("part").mapInArrow(_firsts, "_id long, pos binary")
    by_doc = first.groupBy("_id").agg(F.collect_list("pos").alias("_first"))

    n = len(docs.columns)
    plain = docs.toDF(*(f"c{i}" for i in range(n)))
    joined = plain.withColumn("_id", F.col(f"c{docs.columns.index('doc_id')}").cast("long")).join(by_doc, "_id", "left").select(*plain.columns, "_id", "_first")
    fields = ", ".join(f"{c} {plain.schema[c].dataType.simpleString()}" for c in plain.columns)
    out = joined.mapInArrow(_kept_of(block, window, filters, n, docs.columns.index("text"), digest), f"{fields}, n_words long, n_removed long, kept string")
    return out.toDF(*docs.columns, *free_names(docs.columns, ["_n_words", "_n_removed", "_kept"]))


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = substring_dedup(docs, 20, digest=True)
    return out.select(
        "doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.col("_kept").alias("kept_sha256")
    )
