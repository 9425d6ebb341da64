"""Byte-level BPE encoding and decoding with a transducer lexicon of the corpus's frequent words.

All pre-tokens of the corpus are counted; the most frequent ones, `lexicon` at most, are compiled into a minimal acyclic
transducer with their ids as output, which is broadcast (its size is bounded by that number) and mapped into memory by
each worker. Frequent words take their ids from it. Words that it lacks are merged exactly, many at a time: of each
word the leftmost pair of the lowest rank is merged until none is left. A word's ids don't depend on where they come
from, so the lexicon changes only the speed.

Cases: null and empty texts have no ids. A special token's string in a text takes its own id, as in the library.
Texts of any length are encoded whole. Rows, ties and other columns are left alone. Every merge is exact; two different
pre-tokens of a slice or of a worker's memory are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.words import buffers, freed
from kindred.llm.memory import WordMemory
from kindred.llm.pretokens import PreTokens, _rows, gather
from kindred.llm.samples import free_names
from kindred.llm.transducer import Lexicon, compile_words
from kindred.plans.storage import Scratch

LEXICON = 1 << 16
SLICE = 1 << 19
#: Words in a worker's memory, and bytes of a word that is merged among others.
MEMORY, SHORT = 500_000, 32
_NONE = np.int64(1 << 40)
#: Code points of the longest word in the lexicon, and steps in which counts are told apart for each doubling.
LONGEST, STEPS = 64, 16


@cache
def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files of byte-level BPE."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Vocabulary and merges of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        kind = file["pre_tokenizer"]
        if model["type"] != "BPE" or kind["type"] != "ByteLevel" or kind["add_prefix_space"] or file["normalizer"] or model.get("ignore_merges"):
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        vocab, letters = model["vocab"], byte_letters()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, whole = (np.array([vocab[x] for x in xs], np.int64) for xs in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int64), whole[order]
        self.table = {(a, b): (i, c) for i, (a, b, c) in reversed(list(enumerate(zip(left.tolist(), right.tolist(), whole.tolist(), strict=True))))}
        self.of_byte = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.of_byte[b] = vocab[letter]
        self.specials = {t["content"]: t["id"] for t in file["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in file["added_tokens"]):
            raise ValueError("added tokens that look at their surroundings are not supported")
        longest_first = sorted((t.encode() for t in self.specials), key=len, reverse=True)
        self.special = re.compile(b"|".join(map(re.escape, longest_first))) if longest_first else None
        names = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t not in self.specials} | {i: t.encode() for t, i in self.specials.items()}
        texts = [names.get(i, b"") for i in range(max(names) + 1)]
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.begins, self.bytes = np.cumsum(self.lengths) - self.lengths, np.frombuffer(b"".join(texts), np.uint8)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        ok = (self.key[at] == key) & (a >= 0) & (b >= 0)
        return np.where(ok, self.rank[at], _NONE), np.where(ok, self.made[at], -1)

    def merge_many(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """The ids of each word data[start:end]."""
        out: list = [None] * len(start)
        size = end - start
        for i in np.flatnonzero(size > SHORT).tolist():
            out[i] = np.array(self.merge_long(data[start[i] : end[i]]), np.int32)
        todo = np.flatnonzero(size <= SHORT)
        todo = todo[np.argsort(size[todo], kind="stable")]
        for lo in range(0, len(todo), 20_000):
            self._merge_short(data, start, size, todo[lo : lo + 20_000], out)
        return out

    def _merge_short(self, data, start, size, rows, out) -> None:
        n = size[rows]
        width = int(n.max())
        grid = start[rows][:, None] + np.arange(width)
        ids = np.where(np.arange(width) < n[:, None], self.of_byte[data[np.minimum(grid, len(data) - 1)]], -1)
        rank, made = self._ranks(ids[:, :-1], ids[:, 1:]) if width > 1 else (np.full((len(rows), 1), _NONE), np.full((len(rows), 1), -1))
        live = np.arange(len(rows))
        now = ids, rank, made
        while len(live):
            x, r, m = now
            at = r.argmin(1)
            every = np.arange(len(live))
            go = r[every, at] < _NONE
            for i in np.flatnonzero(~go).tolist():
                out[rows[live[i]]] = x[i][x[i] >= 0].astype(np.int32)
            live, at, x, r, m = live[go], at[go], x[go], r[go], m[go]
            if not len(live):
                break
            every = np.arange(len(live))
            x[every, at] = m[every, at]
            cols = np.arange(x.shape[1])
            follow = np.minimum(cols + (cols > at[:, None]), x.shape[1] - 1)
            x = np.take_along_axis(x, follow, 1)
            x[:, -1] = -1
            cols = np.arange(r.shape[1])
            follow = np.minimum(cols + (cols >= at[:, None]), r.shape[1] - 1)
            r, m = np.take_along_axis(r, follow, 1), np.take_along_axis(m, follow, 1)
            r[:, -1], m[:, -1] = _NONE, -1
            left = at > 0
            if left.any():
                i, c = every[left], at[left] - 1
                r[i, c], m[i, c] = self._ranks(x[i, c], x[i, c + 1])
            right = at + 1 < x.shape[1]
            i, c = every[right], at[right]
            r[i, c], m[i, c] = self._ranks(x[i, c], x[i, c + 1])
            now = x, r, m

    def merge_long(self, word: np.ndarray) -> list[int]:
        ids = self.of_byte[word].tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(*self.table[p][:1], i, *p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in self.table]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.table[a, b][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (hit := self.table.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (hit[0], x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]


@cache
def merges(path: str) -> Merges:
    return Merges(path)


class Coder:
    def __init__(self, path: str, compiled: bytes):
        self.merges, self.lexicon = merges(path), Lexicon(compiled)
        self.memory = WordMemory(MEMORY)

    def encode(self, data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and the rows' bounds in them."""
        if self.merges.special and self.merges.special.search(data):
            return self._with_specials(data, bounds)
        return self._plain(data, bounds)

    def _plain(self, data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes, at = _rows(data, bounds)
        t = PreTokens(codes, at, True)
        if not len(t.start):
            return np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
        heads = np.append(np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), len(data))
        raw = np.frombuffer(data, np.uint8)
        h, first, to = np.unique(t.hash, return_index=True, return_inverse=True)
        start, end = heads[t.start[first]], heads[t.end[first]]
        rank = self.lexicon.ranks(raw, start, end)
        lack = np.flatnonzero(rank < 0)
        place = self.memory.numbers(h[lack], lambda new: self._merged(raw, start[lack[new]], end[lack[new]]))
        size, begin = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        have = rank >= 0
        size[have], begin[have] = self.lexicon.lengths[rank[have]], self.lexicon.begins[rank[have]]
        known = len(self.lexicon.ids)
        size[lack], begin[lack] = self.memory.sizes[place], self.memory.begins[place].astype(np.int64) + known
        each = size[to]
        ids = gather(each, begin[to], np.concatenate([self.lexicon.ids, self.memory.store[: self.memory.used]]))
        ends = np.concatenate([[0], np.cumsum(each)])
        return ids, ends[t.first]

    def _merged(self, raw, start, end) -> tuple[np.ndarray, np.ndarray]:
        """Ids and numbers of ids of words outside the lexicon that the worker hasn't met."""
        found = self.merges.merge_many(raw, start, end)
        return np.concatenate(found), np.array([len(x) for x in found], np.int32)

    def _with_specials(self, data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces between special tokens are encoded as rows, and the tokens' ids put after them."""
        cuts, after, last = [0], [], []
        pieces = []
        for a, b in zip(bounds.tolist(), bounds.tolist()[1:]):
            at = a
            for m in self.merges.special.finditer(data, a, b):
                pieces.append(data[at : m.start()])
                after.append(self.merges.specials[m[0].decode()])
                at = m.end()
            pieces.append(data[at:b])
            after.append(-1)
            last.append(len(pieces))
        cuts = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        ids, ends = self._plain(b"".join(pieces), cuts)
        after = np.array(after, np.int32)
        put = after >= 0
        ends_after = ends + np.concatenate([[0], np.cumsum(put)])
        return np.insert(ids, ends[1:][put], after[put]), ends_after[np.array([0, *last])]

    def decode(self, ids: np.ndarray) -> bytes:
        m = self.merges
        out = gather(m.lengths[ids], m.begins[ids], m.bytes).tobytes()
        return out.decode("utf-8", "replace").encode()


_coders: dict[tuple, Coder] = {}


def _spans(column: pa.Array, most: int = SLICE):
    """Slices of about `most` bytes: first row, bytes and row bounds."""
    data, at = buffers(column)
    lo, rows = 0, len(at) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, data[at[lo] : at[hi]].tobytes(), at[lo : hi + 1] - at[lo]
        lo = hi


def _counted(batches):
    _coders.clear()  # a worker that has encoded for an earlier query holds that one's words
    for batch in freed(batches):
        held: dict[str, int] = {}
        for _, data, bounds in _spans(batch.column(0)):
            t = PreTokens(*_rows(data, bounds), True)
            _, first, n = np.unique(t.hash, return_index=True, return_counts=True)
            short = t.end[first] - t.start[first] <= LONGEST
            first, n = first[short], n[short]
            for i, c in zip(first.tolist(), n.tolist(), strict=True):
                word = t.text(i)
                held[word] = held.get(word, 0) + c
            if len(held) > 200_000:
                yield _word_rows(held)
                held = {}
        yield _word_rows(held)


def _word_rows(held: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])


def frequent_words(docs: DataFrame, most: int) -> list[str]:
    """Frequent pre-tokens by their counts over all texts: as many as there are above a count, `most` at most.

    A histogram of the counts, of some hundred rows, tells the count; so the driver gets the words of the lexicon alone,
    whatever the size of the corpus. Words that occur once or are longer than LONGEST are left to the merges.
    """
    if most <= 0:
        return []
    scratch = Scratch(docs.sparkSession, "words")
    counts = docs.select("text").mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    counts = scratch.write(counts.withColumn("step", F.floor(F.log2("n") * STEPS).cast("int")), "counts")
    steps = sorted(((r.step, r.words) for r in counts.groupBy("step").agg(F.count("*").alias("words")).collect()), reverse=True)
    total, least = 0, None
    for step, words in steps:
        if (total := total + words) > most:
            break
        least = step
    out = [] if least is None else [r.word for r in counts.where(F.col("step") >= least).select("word").toLocalIterator()]
    scratch.drop(counts)
    return sorted(out)


def compile_lexicon(words: list[str], path: str) -> bytes:
    m = merges(path)
    raw = sorted({w.encode() for w in words if w and not any(s in w for s in m.specials)})
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    return compile_words(raw, [x.tolist() for x in m.merge_many(data, bounds[:-1], bounds[1:])] if raw else [])


def _coder(path: str, lexicon) -> Coder:
    key = path, lexicon.id if hasattr(lexicon, "id") else id(lexicon)
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(path, lexicon.value)
    return _coders[key]


def _encoded_of(path: str, lexicon, text_at: int, digest: bool):
    def run(batches):
        for batch in freed(batches):
            coder = _coder(path, lexicon)
            n, ids_out, text_out = [], [], []
            for _, data, bounds in _spans(batch.column(text_at)):
                ids, ends = coder.encode(data, bounds)
                flat = ids.astype("<u4")
                texts = coder.decode(ids)
                sizes = np.concatenate([[0], np.cumsum(coder.merges.lengths[ids])])[ends]
                whole = len(texts) == sizes[-1]
                for i, (a, b) in enumerate(zip(ends.tolist(), ends.tolist()[1:])):
                    n.append(b - a)
                    text = texts[sizes[i] : sizes[i + 1]] if whole else coder.decode(ids[a:b])
                    if digest:
                        ids_out.append(hashlib.sha256(flat[a:b].tobytes()).hexdigest())
                        text_out.append(hashlib.sha256(text).hexdigest())
                    else:
                        ids_out.append(ids[a:b])
                        text_out.append(text.decode())
            kinds = (pa.string(), pa.string()) if digest else (pa.list_(pa.int32()), pa.string())
            extra = [pa.array(n, pa.int64()), pa.array(ids_out, kinds[0]), pa.array(text_out, kinds[1])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*(f"c{i}" for i in range(batch.num_columns)), "n", "ids", "text"])

    return run


def bpe_round_trip(docs: DataFrame, path: str, digest: bool = False, lexicon: int = LEXICON) -> DataFrame:
    """docs with _n_tokens, _ids and _decoded; with digest, the last two are SHA-256 digests."""
    spark = docs.sparkSession
    compiled = spark.sparkContext.broadcast(compile_lexicon(frequent_words(docs, lexicon), path))
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    fields = ", ".join(f"{c} {plain.schema[c].dataType.simpleString()}" for c in plain.columns)
    ids = "string" if digest else "array<int>"
    out = plain.mapInArrow(_encoded_of(path, compiled, docs.columns.index("text"), digest), f"{fields}, n long, ids {ids}, text string")
    return out.toDF(*docs.columns, *free_names(docs.columns, ["_n_tokens", "_ids", "_decoded"]))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = bpe_round_trip(docs, default_path(), digest=True)
    return out.select("doc_id", F.col("_n_tokens").alias("n_tokens"), F.col("_ids").alias("ids_sha256"), F.col("_decoded").alias("decoded_sha256"))
