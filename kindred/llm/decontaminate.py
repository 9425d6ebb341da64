"""Benchmark decontamination with a generalised suffix automaton of the items' words.

Items are normalised to words (A to Z lower-cased; digits, a to z and all that is not ASCII) and put into one suffix
automaton, item after item. Documents stream through it word by word; the state gives the longest match that ends at
each word. A match of `window` words, or of a whole shorter item, is an occurrence: its words are hit, and the items
that hold it are those of the state's shortest ancestor that is long enough.

A word that no item has resets the automaton, and a pair of words that no item has in this order leaves a match of one
word. Both are told by hashes for whole batches, so only the runs between, which hold all matches of two words or
more, are walked, by the words themselves: hashes decide nothing but where not to look.

Two limits decide what is removed: a match of the length `window` takes its words, and a document of which more than a
share `coverage` of all words is hit loses its whole text, as little but copied passages would stay.

The items are taken in blocks of at most ITEM_WORDS words, each with an automaton of its own; an item of more is cut
into pieces that overlap by a word less than a window, which hold all its windows. A document is walked once for each
block. Every PASSES blocks the rows are written and the blocks' broadcasts dropped, which bounds what a worker holds
whatever the size of the benchmark.

Cases: null and empty texts have no words and no hits. An item without words never occurs; equal items are hit
together. An item with a null item_id hits words but is not listed. Repeated rows are judged alike. An empty benchmark
hits nothing. Other columns of docs pass through; a name that is added gets another underscore if docs has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.words import ALNUM, mix, poly, sliced
from kindred.llm.samples import free_names
from kindred.plans.storage import Scratch

WINDOW, ITEM_WORDS = 10, 200_000
#: Share of hit words beyond which a document counts as copied, and blocks that a worker holds at a time.
COVERAGE, PASSES = 0.8, 4
_PAIR = 0xD6E8FEB86659FD93


class SuffixAutomaton:
    """A generalised suffix automaton: every run of words of any item is a path from state 0."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.items: list[set] = [set()]  # of a state: items in which its runs end
        self.whole: list[bool] = [False]  # a whole short item ends here

    def _state(self, length: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.items.append(set())
        self.whole.append(False)
        return len(self.next) - 1

    def _split(self, p: int, c, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c) -> int:
        if (q := self.next[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def add(self, words: list) -> None:
        last = 0
        for c in words:
            last = self._extend(last, c)

    def finish(self, items: list[tuple[int, list]], window: int) -> None:
        """Marks, once all items are in, where items end and what items the runs of a state are in."""
        self.window = window
        for item, words in items:
            at = 0
            for c in words:
                at = self.next[at][c]
                self.items[at].add(item)
            if 0 < len(words) < window:
                self.whole[at] = True
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            self.items[self.link[s]] |= self.items[s]
        self.items[0] = set()
        self.shorter = [-1] * len(self.link)  # the nearest state from here up that is a whole short item
        for s in sorted(range(1, len(self.link)), key=lambda s: self.length[s]):
            up = self.link[s]
            self.shorter[s] = s if self.whole[s] else self.shorter[up] if up > 0 else -1

    def walk(self, words: list) -> tuple[list[tuple[int, int]], set]:
        """Matches as (first word, length), and the items that hold them."""
        state, size, hits, found, w = 0, 0, [], set(), self.window
        for i, c in enumerate(words):
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if (to := self.next[state].get(c)) is None:
                continue
            state, size = to, size + 1
            at = state
            if size >= w:
                while self.length[self.link[at]] >= w:
                    at = self.link[at]
                hits.append((i - w + 1, w))
                found |= self.items[at]
            # short items: those that end here and that the match covers
            at = self.shorter[state]
            while at > 0:
                if self.length[at] <= size:
                    hits.append((i - self.length[at] + 1, self.length[at]))
                    found |= self.ends[at]
                up = self.link[at]
                at = self.shorter[up] if up > 0 else -1
        return hits, found


def build(items: list[tuple[int, list[str]]], window: int) -> SuffixAutomaton:
    out = SuffixAutomaton()
    for _, words in items:
        out.add(words)
    out.finish(items, window)
    out.ends = {}
    for item, words in items:
        if 0 < len(words) < window:
            at = 0
            for c in words:
                at = out.next[at][c]
            out.ends.setdefault(at, set()).add(item)
    return out


def words_of(texts: list[str | None]):
    for lo, hi, w in sliced(pa.array(texts, pa.string()), ALNUM, True):
        raw = w.data.tobytes()
        for r in range(hi - lo):
            yield [raw[a:b].decode() for a, b in zip(w.start[w.first[r] : w.first[r + 1]], w.end[w.first[r] : w.first[r + 1]])]


class Matcher:
    """An automaton of some items, and the hashes that tell where it need not be asked."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        worded = list(zip((i for i, _ in items), words_of([t for _, t in items]), strict=True))
        self.automaton, self.window = build(worded, window), window
        self.least = min((min(len(w), window) for _, w in worded if w), default=window)
        hashes, pairs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for _, _, w in sliced(pa.array([t for _, t in items], pa.string()), ALNUM, True):
            hashes.append(w.hash)
            if len(w.hash) > 1:
                pairs.append(mix(poly(w.hash, 2, _PAIR))[w.inside(2)])
        self.words, self.pairs = np.unique(np.concatenate(hashes)), np.unique(np.concatenate(pairs))

    def runs(self, w) -> list[tuple[int, int]]:
        """Runs of words in one row, at least as long as the shortest match, in which each word and pair is an item's."""
        n = len(w.hash)
        known = _among(w.hash, self.words)
        if self.least <= 1:
            tied = np.zeros(n, bool)
            tied[1:] = known[1:] & known[:-1] & w.inside(2) if n > 1 else False
            if n > 1:
                at = np.flatnonzero(tied)
                tied[at] = _among(mix(w.hash[at - 1] + w.hash[at] * np.uint64(_PAIR)), self.pairs)
            starts = np.flatnonzero(known & ~tied)
        else:
            tied = np.zeros(n + 1, bool)
            if n > 1:
                at = np.flatnonzero(known[1:] & known[:-1] & w.inside(2)) + 1
                tied[at] = _among(mix(w.hash[at - 1] + w.hash[at] * np.uint64(_PAIR)), self.pairs)
            starts = np.flatnonzero(tied[1:] & ~tied[:-1]) if n else np.zeros(0, np.int64)
        if not len(starts):
            return []
        tied = np.append(tied[:n], False)
        breaks = np.flatnonzero(~tied)
        ends = breaks[np.searchsorted(breaks, starts + 1)]
        long = ends - starts >= self.least
        return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


def _among(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(h), bool)
    return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h


def _hits_of(matcher, columns: int, text_at: int, first: bool, last: bool, with_clean: bool, coverage: float):
    """A pass over rows with one block's matcher; all passes but the last hand on what is hit (runs of words) and items."""

    def run(batches):
        for batch in batches:
            n_words, n_hit, items_out, hits_out, clean = [], [], [], [], []
            for lo, hi, w in sliced(batch.column(text_at), ALNUM, True):
                covered, found = np.zeros(len(w.hash) + 1, np.int64), [set() for _ in range(hi - lo)]
                if not first:
                    for r in range(hi - lo):
                        found[r] |= set(batch.column(columns + 1)[lo + r].as_py())
                        spans = np.frombuffer(batch.column(columns)[lo + r].as_py(), np.int32).reshape(-1, 2) + w.first[r]
                        np.add.at(covered, spans[:, 0], 1)
                        np.add.at(covered, spans[:, 1], -1)
                for a, b in matcher.value.runs(w) if matcher else ():
                    words = [w.data[x:y].tobytes().decode() for x, y in zip(w.start[a:b].tolist(), w.end[a:b].tolist())]
                    hits, items = matcher.value.automaton.walk(words)
                    for at, size in hits:
                        covered[a + at] += 1
                        covered[a + at + size] -= 1
                    if items:
                        found[int(np.searchsorted(w.first, a, "right")) - 1] |= {str(x) for x in items if x is not None}
                gone = np.cumsum(covered)[:-1] > 0
                counts = np.concatenate([[0], np.cumsum(gone)])[w.first]
                n_words += np.diff(w.first).tolist()
                n_hit += np.diff(counts).tolist()
                items_out += [sorted(s) for s in found]
                if not last:
                    hits_out += [_runs(w, gone, r).astype(np.int32).tobytes() for r in range(hi - lo)]
                elif with_clean:
                    texts = batch.column(text_at).slice(lo, hi - lo).to_pylist()
                    share = np.diff(counts) / np.maximum(1, np.diff(w.first))
                    clean += ["" if share[r] > coverage else _without(t, _spans(w, gone, r) if counts[r + 1] > counts[r] else []) for r, t in enumerate(texts)]
            items = pa.array(items_out, pa.list_(pa.string()))
            if last:
                extra = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), items, *[pa.array(clean, pa.string())] * with_clean]
            else:
                extra = [pa.array(hits_out, pa.binary()), items]
            yield pa.RecordBatch.from_arrays([*batch.columns[:columns], *extra], [f"c{i}" for i in range(columns + len(extra))])

    return run


def _runs(w, gone: np.ndarray, r: int) -> np.ndarray:
    """Runs of hit words of a row, as first word and word after the last, counted from the row's own start."""
    return np.flatnonzero(np.diff(np.concatenate([[0], gone[w.first[r] : w.first[r + 1]].astype(np.int8), [0]]))).reshape(-1, 2)


def _spans(w, gone: np.ndarray, r: int) -> list[tuple[int, int]]:
    """The bytes of a row from the first to the last word of each run of hit words."""
    a = w.first[r]
    return [(int(w.start[a + x] - w.at[r]), int(w.end[a + y - 1] - w.at[r])) for x, y in _runs(w, gone, r)]


def _without(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    if not spans:
        return text
    raw, out, at = text.encode(), [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]]).decode()


def pieces(text: str, window: int, most: int) -> Iterator[str]:
    """The text, or if it has more words, parts of `most` words that overlap by a word less than a window."""
    most = max(most, window)
    if len(text) < 2 * most:  # too short for so many words
        yield text
        return
    for _, _, w in sliced(pa.array([text], pa.string()), ALNUM, True, len(text.encode()) + 1):
        n, raw = len(w.start), w.data.tobytes()
        if n <= most:
            yield text
            return
        for a in range(0, n - window + 1, most - window + 1):
            yield raw[w.start[a] : w.end[min(n, a + most) - 1]].decode()


def matchers_of(items: DataFrame, window: int) -> Iterator[Matcher]:
    """Matchers of blocks of items; the driver holds one block's texts at a time and yields its matcher."""
    block, size = [], 0
    for r in items.where("text is not null").orderBy("item_id", "text").select("item_id", "text").toLocalIterator():
        for piece in pieces(r.text, window, ITEM_WORDS):
            block.append((r.item_id, piece))
            size += len(piece) // 4
            if size >= ITEM_WORDS:
                yield Matcher(block, window)
                block, size = [], 0
    if block:
        yield Matcher(block, window)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, clean: bool = False, coverage: float = COVERAGE) -> DataFrame:
    """docs with _n_words, _n_hit, _items (sorted as strings) and, if asked for, _clean: the text without hit words.

    Each block of items is a pass of its own, on the rows that the pass before hands on.
    """
    spark, n, text_at = docs.sparkSession, len(docs.columns), docs.columns.index("text")
    now = docs.toDF(*(f"c{i}" for i in range(n)))
    fields = [f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(now.schema)]
    kinds = ["long", "long", "array<string>", *["string"] * clean], ["binary", "array<string>"]
    scratch, held, written = Scratch(spark, "hits"), [], []
    matchers = matchers_of(items, window)
    matcher, i = next(matchers, None), 0
    while True:
        after = next(matchers, None)
        last = after is None
        shared = spark.sparkContext.broadcast(matcher) if matcher else None
        schema = ", ".join([*fields, *(f"c{n + j} {k}" for j, k in enumerate(kinds[not last]))])
        now = now.mapInArrow(_hits_of(shared, n, text_at, i == 0, last, clean, coverage), schema)
        held.append(shared)
        if last:
            break
        matcher, i = after, i + 1
        if len(held) == PASSES:
            written.append(now := scratch.write(now, "rows"))
            for x in held:
                x.unpersist()
            held = []
            if len(written) > 1:
                scratch.drop(written.pop(0))
    return now.toDF(*docs.columns, *free_names(docs.columns, ["_n_words", "_n_hit", "_items", *["_clean"] * clean]))


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = contamination(docs, items, WINDOW)
    return out.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (F.col("_n_hit") > 0).alias("contaminated"),
        (F.col("_n_hit") > COVERAGE * F.col("_n_words")).alias("copied"),
    )
