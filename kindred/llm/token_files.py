"""Token-id files of patched frame-of-reference blocks.

A file holds the ids of a run of documents in ascending order of doc_id. A block of BLOCK ids stores its minimum, and of
each id the difference to it, packed at the bit width that a percentile of the differences needs. Differences beyond
that width keep their low bits in place, and the exception list of the block has their positions and high bits. The
file's index has the place where each block starts, so that any id is found by reading one block.

    header   "KTF1", u32 ids, u32 documents, u32 blocks, u32 ids in a block
    index    u32 x blocks: where each block starts, from the end of the index
    lengths  u32 x documents: ids of each document
    block    u32 minimum, u8 width, u8 high width in bytes, u16 exceptions, packed words (u32), u16 x positions, high parts

Files are rows of a Parquet table, which any store that Spark writes to can hold, and whose commit keeps one attempt of
each task. A row is (file, first_doc, doc_ids, n_ids, image).

Cases: null and empty texts have the end id alone. Rows are ordered by doc_id, nulls first, and rows that repeat a
doc_id by a hash of their text, equal hashes by the text. Text of any length is encoded whole. An empty table gives no file. Other columns are not stored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.bpe import _spans, byte_letters
from kindred.llm.memory import WordMemory
from kindred.llm.pretokens import PreTokens, gather, normal_rows
from kindred.plans.storage import Scratch

BLOCK, PERCENTILE = 1024, 90
#: Bytes of text for each range of documents that a task writes, and ids after which it starts the next file.
RANGE_BYTES, FILE_IDS = 16 << 20, 1 << 18
#: Words in a worker's memory.
MEMORY = 2_000_000
_MAGIC = b"KTF1"
_HEAD = np.dtype([("least", "<u4"), ("width", "u1"), ("size", "u1"), ("n", "<u2")])


def _width(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def encode_file(ids: np.ndarray, lengths: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """The image of a file with the ids of documents of those lengths."""
    ids = np.asarray(ids, np.int64)
    n = -(-len(ids) // block)
    padded = np.concatenate([ids, np.repeat(ids[-1:], n * block - len(ids))]).reshape(n, block) if n else np.zeros((0, block), np.int64)
    base = padded.min(1) if n else np.zeros(0, np.int64)
    rest = padded - base[:, None]
    width = _width(np.percentile(rest, percentile, axis=1, method="higher")) if n else np.zeros(0, np.int64)
    low = rest & ((np.int64(1) << width) - 1)[:, None]
    high = rest >> width[:, None]
    images = [b""] * n
    for w in np.unique(width).tolist():
        every = np.flatnonzero(width == w)
        for at in np.array_split(every, max(1, len(every) // 32)):
            kind = "<u2" if w <= 16 else "<u4"
            bits = np.unpackbits(low[at].astype(kind).reshape(-1, 1).view(np.uint8), axis=1, count=w, bitorder="little") if w else np.zeros((0, 0), np.uint8)
            packed = np.packbits(bits.reshape(len(at), -1), axis=1, bitorder="little") if w else np.zeros((len(at), 0), np.uint8)
            for row, i in zip(packed, at.tolist(), strict=True):
                out = np.flatnonzero(high[i])
                top = high[i][out]
                size = 0 if not len(out) else 1 if top.max() < 1 << 8 else 2 if top.max() < 1 << 16 else 4
                tail = out.astype("<u2").tobytes() + (top.astype(f"<u{size}").tobytes() if size else b"")
                images[i] = struct.pack("<IBBH", int(base[i]), w, size, len(out)) + row.tobytes() + tail
    starts = np.cumsum([0, *(len(x) for x in images[:-1])]) if n else np.zeros(0)
    head = _MAGIC + struct.pack("<4I", len(ids), len(lengths), n, block)
    return head + starts.astype("<u4").tobytes() + np.asarray(lengths).astype("<u4").tobytes() + b"".join(images)


class TokenFile:
    """Reads an image: lengths of its documents, all ids, or the ids of a range by the block index."""

    def __init__(self, image: bytes):
        if image[:4] != _MAGIC:
            raise ValueError("not a token file")
        self.image = image
        self.n_ids, self.n_docs, self.n_blocks, self.block = struct.unpack_from("<4I", image, 4)
        self.starts = np.frombuffer(image, "<u4", self.n_blocks, 20)
        self.lengths = np.frombuffer(image, "<u4", self.n_docs, 20 + 4 * self.n_blocks).astype(np.int64)
        self.base = 20 + 4 * (self.n_blocks + self.n_docs)

    def read_blocks(self, first: int, last: int) -> np.ndarray:
        """The ids of blocks first to last, blocks of one width together."""
        raw = np.frombuffer(self.image, np.uint8)
        at = self.base + self.starts[first : last + 1].astype(np.int64)
        heads = raw[at[:, None] + np.arange(8)].copy().view(_HEAD).ravel()
        out = np.zeros((len(at), self.block), np.int64)
        many = -(-self.block * heads["width"].astype(np.int64) // 8)
        for w in np.unique(heads["width"]).tolist():
            if w:
                rows = np.flatnonzero(heads["width"] == w)
                kind = np.dtype("<u2" if w <= 16 else "<u4")
                for part in np.array_split(rows, max(1, len(rows) // 32)):
                    bits = np.unpackbits(raw[(at[part] + 8)[:, None] + np.arange(many[part[0]])], axis=1, count=self.block * w, bitorder="little")
                    whole = np.packbits(bits.reshape(-1, w), axis=1, bitorder="little")
                    out[part] = np.pad(whole, ((0, 0), (0, kind.itemsize - whole.shape[1]))).view(kind).reshape(len(part), -1)
        for i in np.flatnonzero(heads["n"]).tolist():
            n, width, size, place = int(heads["n"][i]), int(heads["width"][i]), int(heads["size"][i]), int(at[i] + 8 + many[i])
            where = np.frombuffer(self.image, "<u2", n, place)
            out[i, where] |= np.frombuffer(self.image, f"<u{size}", n, place + 2 * n).astype(np.int64) << width
        return (out + heads["least"].astype(np.int64)[:, None]).ravel()[: self.n_ids - first * self.block]

    def ids(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        hi = self.n_ids if hi is None else min(hi, self.n_ids)
        if lo >= hi:
            return np.zeros(0, np.uint32)
        first, last = lo // self.block, (hi - 1) // self.block
        out = self.read_blocks(first, last)
        return out[lo - first * self.block : hi - first * self.block].astype(np.uint32)


class WordCoder:
    """Ids of words by the tokenizers library; a worker asks its model for each word once while its memory lasts.

    Words are told apart by 64-bit hashes: two of a worker's words would have to agree in one to get wrong ids.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        letters = np.zeros(256, "<u4")
        for letter, b in byte_letters().items():
            letters[b] = ord(letter)
        self.letters = letters
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memory = WordMemory(MEMORY)

    def _ids_of(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and numbers of ids of words codes[start:end], as the library's model gives them."""
        n = end - start
        # the model takes a pre-token as the letters that stand for its bytes
        raw = gather(n, start, codes).astype("<u4").tobytes().decode("utf-32-le")
        heads = np.concatenate([[0], np.cumsum(n)])
        data = np.frombuffer(raw.encode(), np.uint8)
        if len(data) > len(raw):
            heads = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))[heads]
        text, ends, tokenize = self.letters[data].tobytes().decode("utf-32-le"), heads.tolist(), self.model.tokenize
        found = [[t.id for t in tokenize(text[a:b])] for a, b in zip(ends, ends[1:])]
        return np.array([i for x in found for i in x], np.int32), np.array([len(x) for x in found], np.int32)

    def encode(self, data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and the rows' bounds in them."""
        if any(s in data for s in self.specials):
            rows = [self.tokenizer.encode(data[a:b].decode(), add_special_tokens=False).ids for a, b in zip(bounds, bounds[1:])]
            return np.array([i for r in rows for i in r], np.int32), np.cumsum([0, *map(len, rows)])
        t = PreTokens(*normal_rows(data, bounds), False)
        if not len(t.start):
            return np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
        h, first, to = np.unique(t.hash, return_index=True, return_inverse=True)
        at = self.memory.numbers(h, lambda new: self._ids_of(t.codes, t.start[first[new]], t.end[first[new]]))[to]
        each = self.memory.sizes[at].astype(np.int64)
        return gather(each, self.memory.begins[at].astype(np.int64), self.memory.store), np.concatenate([[0], np.cumsum(each)])[t.first]


_coders: dict[str, WordCoder] = {}


def _files_of(path: str, end_id: int):
    """Rows (doc_id, text) come in their final order; rows of one partition make files of their own."""

    def run(batches):
        coder = _coders.get(path) or _coders.setdefault(path, WordCoder(path))
        part, file, held = None, 0, [[], [], []]

        def flush():
            nonlocal file, held
            lengths = np.concatenate(held[1])
            image = encode_file(np.concatenate(held[2]), lengths)
            docs = [x for c in held[0] for x in c.to_pylist()]
            file += 1
            held = [[], [], []]
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([file - 1], pa.int32()), pa.array([docs], pa.list_(pa.int64())), pa.array([int(lengths.sum())], pa.int64()), pa.array([image], pa.binary())],
                ["part", "file", "doc_ids", "n_ids", "image"],
            )

        for batch in batches:
            for lo, data, bounds in _spans(batch.column(1)):
                ids, ends = coder.encode(data, bounds)
                n = np.diff(ends) + 1
                out = np.insert(ids.astype(np.int64), ends[1:], end_id)
                part = batch.column(2)[0].as_py() if part is None else part
                held[0].append(batch.column(0).slice(lo, len(bounds) - 1))
                held[1].append(n)
                held[2].append(out)
                if sum(map(len, held[2])) >= FILE_IDS:
                    yield flush()
        if held[0]:
            yield flush()

    return run


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes the files in the shared folder and returns their table, in which `start` is the number of ids before."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(2, size // RANGE_BYTES)
    slim = docs.select(F.col("doc_id").cast("long"), "text")
    rows = slim.repartitionByRange(ranges, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text").withColumn("part", F.spark_partition_id())
    made = rows.mapInArrow(_files_of(tokenizer, end_id), "part int, file int, doc_ids array<long>, n_ids long, image binary")
    files = scratch.write(made, "files")
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    starts = files.select("part", "file", "n_ids").withColumn("within", within).join(before.select("part", "before"), "part")
    starts = starts.select("part", "file", (F.coalesce("before", F.lit(0)) + F.coalesce("within", F.lit(0))).alias("start"))
    return files.join(F.broadcast(starts) if ranges < 100_000 else starts, ["part", "file"])


def _read(batches):
    for batch in batches:
        for docs, start, image in zip(*(batch.column(i) for i in range(3)), strict=True):
            f = TokenFile(image.as_py())
            ends = np.concatenate([[0], np.cumsum(f.lengths)])
            raw = f.ids().astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends.tolist(), ends.tolist()[1:])]
            yield pa.RecordBatch.from_arrays([docs.values, pa.array(ends[:-1] + start.as_py()), pa.array(f.lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    files = write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"))
    return files.select("doc_ids", "start", "image").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
