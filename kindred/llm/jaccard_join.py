"""Exact n-gram Jaccard join by prefix trees, and the groups that its links form.

A document's set is its distinct k-word shingles, lower-cased in A to Z; with fewer words than k, the whole sequence
is its one shingle. Two documents link when den * |intersection| >= num * |union|.

1. Equal sets are one node, named by the smallest doc_id: copies are never expanded into pairs.
2. Shingles get one global order: those of a fixed share of the hash space first, of these the ones of one document
   only, then those of few, then of many (told by filters over all documents, see filters.py), then by hash. Any fixed
   order is correct, a good one is fast. Linked sets share one of the first n - ceil(n * num / den) + 1 shingles of
   either; those that no other document has need not be looked up. The holders of a shingle, sorted by set size, are
   chained to their neighbours unless the sizes alone rule out a link, which takes rows in proportion to the holders.
   Components of the chains hold all links.
3. Components are sorted by set size over all tasks, and each one's sets are dealt into blocks of bounded length and
   number of shingles as they come, so that no task numbers a component. A block's sets, packed as numbers that rise in
   the global order, go into a radix tree in that order from its end, most frequent first, so that similar sets share paths. Each set walks the tree with the overlap so far, which
   the sets below a node share, and leaves a subtree that can't reach the needed overlap with the lengths that remain.
4. Blocks of one component are then joined with each other, but for pairs that sizes rule out or whose sets are all
   linked already. So a large group of near copies, linked within its blocks, needs few or no further joins.

Sets are held as 64-bit shingle hashes, nodes as 128-bit set hashes. Links found connect the same groups as all links.

Cases: null and empty texts have no shingles and link with nothing. Rows with a null doc_id get a null component and
link with nothing. Rows that repeat a doc_id count as one document. Ties between equal sets go to the smallest doc_id.
An empty table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.filters import MOST_ONCE, SCHEMA, bits_for, build, has, packed
from kindred.functions.words import SPACED, longs, mix, poly, sliced
from kindred.operators.components import connected_components
from kindred.plans.storage import Scratch

#: A shingle is frequent from about so many documents on.
OFTEN = 32
BITS_EACH = 8
#: Sets in a block of a component (a power of two), and about the shingles from which on a block has fewer sets.
BLOCK, BLOCK_SHINGLES = 256, 1 << 18
#: Tokens of an edge that a walk compares between two looks at the bound.
STRIDE = 64

_SALT = (np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3))


def shingle_sets(column: pa.Array, k: int):
    """For each row its sorted distinct shingle hashes."""
    for lo, hi, w in sliced(column, SPACED, True):
        h = w.grams(k)
        for r in range(hi - lo):
            a, b = w.first[r], w.first[r + 1]
            if b - a >= k:
                yield lo + r, np.unique(h[a : b - k + 1])
            elif b > a:
                yield lo + r, mix(poly(w.hash[a:b], int(b - a), 0xC2B2AE3D27D4EB4F) + np.uint64(b - a))
            else:
                yield lo + r, np.zeros(0, np.uint64)


def _nodes_of(k: int):
    def run(batches):
        for batch in batches:
            n, f = np.zeros(len(batch), np.int32), np.zeros((2, len(batch)), np.uint64)
            for r, s in shingle_sets(batch.column(1), k):
                n[r] = len(s)
                f[0, r], f[1, r] = mix(s ^ _SALT[0]).sum(dtype=np.uint64), mix(s ^ _SALT[1]).sum(dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), longs(f[0]), longs(f[1])], ["doc_id", "n", "f1", "f2"])

    return run


class Order:
    """The global order of shingles. share: of the hash space, whose shingles come first and are known to the filters."""

    def __init__(self, share: float, twice: np.ndarray, many: np.ndarray):
        self.most, self.twice, self.many = np.uint64(int(min(share, 1) * (2**64 - 1))), twice, many

    def levels(self, h: np.ndarray) -> np.ndarray:
        """0: of one document; 1: of some; 2: of many; 3: not known."""
        out = np.full(len(h), 3, np.uint8)
        known = np.flatnonzero(_low(h, self.most))
        again = has(self.twice, h[known])
        out[known] = again
        known = known[again]
        out[known[has(self.many, h[known])]] = 2
        return out


def _low(h: np.ndarray, most) -> np.ndarray:
    return h * np.uint64(0x9E3779B97F4A7C15) <= most


def _known_of(k: int, share: float):
    most = np.uint64(int(min(share, 1) * (2**64 - 1)))

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 5000):
                found = [s[_low(s, most)] for _, s in shingle_sets(batch.column(0).slice(lo, 5000), k)]
                yield packed(np.concatenate(found or [np.zeros(0, np.uint64)]))

    return run


def global_order(docs: DataFrame, k: int, share: float) -> Order:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = bits_for(size / 5 * min(share, 1), BITS_EACH)
    return Order(share, *build(docs.select("text").mapInArrow(_known_of(k, share), SCHEMA), bits, often=OFTEN))


def _ordered(s: np.ndarray, order: Order) -> tuple[np.ndarray, np.ndarray]:
    """The set in the global order, and its levels."""
    levels = order.levels(s)
    at = np.argsort(levels, kind="stable")
    return s[at], levels[at]


def _prefix_of(k: int, num: int, den: int, order):
    def run(batches):
        for batch in batches:
            ids, seen, got = batch.column(0).to_pylist(), set(), [[], [], []]
            for r, s in shingle_sets(batch.column(1), k):
                n = len(s)
                if not n or ids[r] is None:
                    continue
                key = int(mix(s ^ _SALT[0]).sum(dtype=np.uint64)), int(mix(s ^ _SALT[1]).sum(dtype=np.uint64))
                if key in seen:  # a copy in this batch; its chain goes through the first
                    continue
                seen.add(key)
                p = n - (n * num + den - 1) // den + 1
                s, levels = (x[:p] for x in _ordered(s, order.value))
                s = s[levels > 0]
                got[0].append(s)
                got[1].append(np.full(len(s), n, np.int32))
                got[2].append(np.full(len(s), ids[r], np.int64))
                if len(got[0]) == 1000:
                    yield _tokens(got)
                    got = [[], [], []]
            if got[0]:
                yield _tokens(got)

    return run


def _tokens(got) -> pa.RecordBatch:
    h, n, ids = map(np.concatenate, got)
    return pa.RecordBatch.from_arrays([longs(h), pa.array(n), pa.array(ids)], ["h", "n", "doc_id"])


def _chains_of(num: int, den: int):
    """Edges between neighbours that hold the same shingle; rows come sorted by shingle, size and doc_id."""

    def run(batches):
        last = None
        for batch in batches:
            h, n, ids = (batch.column(i).to_numpy() for i in range(3))
            if last is not None:
                h, n, ids = (np.concatenate([[x], y]) for x, y in zip(last, (h, n, ids), strict=True))
            if not len(h):
                continue
            last = h[-1], n[-1], ids[-1]
            ok = (h[1:] == h[:-1]) & (n[:-1].astype(np.int64) * den >= n[1:].astype(np.int64) * num) & (ids[1:] != ids[:-1])
            pairs = np.unique(np.stack([ids[:-1][ok], ids[1:][ok]], 1), axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _ids(batches):
    for batch in batches:
        yield packed(mix(batch.column(0).to_numpy().view(np.uint64)))


class _Node:
    __slots__ = ("edge", "children", "docs", "least", "most")

    def __init__(self, edge, children, docs, least, most):
        self.edge, self.children, self.docs, self.least, self.most = edge, children, docs, least, most


class PrefixTree:
    """A radix tree of sets, given as rising arrays of token numbers."""

    def __init__(self):
        self.root = _Node(np.zeros(0, np.int64), {}, [], 1 << 60, 0)

    def insert(self, s: np.ndarray, doc: int) -> None:
        node, at, n = self.root, 0, len(s)
        while True:
            node.least, node.most = min(node.least, n), max(node.most, n)
            if at == n:
                node.docs.append(doc)
                return
            child = node.children.get(first := int(s[at]))
            if child is None:
                node.children[first] = _Node(s[at:], {}, [doc], n, n)
                return
            m = min(len(child.edge), n - at)
            differ = np.flatnonzero(child.edge[:m] != s[at : at + m])
            same = int(differ[0]) if len(differ) else m
            if same < len(child.edge):
                upper = _Node(child.edge[:same], {}, [], child.least, child.most)
                child.edge = child.edge[same:]
                upper.children[int(child.edge[0])] = child
                node.children[first] = child = upper
            node, at = child, at + same

    def walk(self, s: np.ndarray, mark: np.ndarray, num: int, den: int):
        """Documents of the tree whose sets link with s; mark is True at the tokens of s."""
        n = len(s)
        stack = [(c, 0, 0) for c in self.root.children.values()]
        while stack:
            node, overlap, depth = stack.pop()
            # overlap needed with the smallest set below: num / (num + den) of both sizes together
            need, most, at, edge = -(-num * (n + node.least) // (num + den)), node.most, 0, node.edge
            while at < len(edge):
                step = edge[at : at + STRIDE]
                overlap += int(np.count_nonzero(mark[step]))
                at += len(step)
                left = n - int(np.searchsorted(s, step[-1], "right"))
                if overlap + min(most - depth - at, left) < need:
                    break
            else:
                depth += at
                if node.docs and den * overlap >= num * (n + depth - overlap):
                    yield from node.docs
                stack.extend((c, overlap, depth) for c in node.children.values())


class _Groups(dict):
    def find(self, x):
        while (up := self.get(x, x)) != x:
            self[x] = x = self.get(up, up)
        return x

    def union(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self[max(a, b)] = min(a, b)


def join_block(sides, docs, roots, sets, num: int, den: int) -> list[tuple[int, int]]:
    """Links that join what isn't joined yet: of sets of side 0 with each other, or where both sides occur, of side 1 with side 0."""
    # any set has its tokens in the global order, so their numbers by place in it rise along each set
    order, at = np.unique(np.concatenate(sets), return_inverse=True)
    parts = np.split(at, np.cumsum([len(s) for s in sets])[:-1])
    mark, groups, tree, out = np.zeros(len(order), bool), _Groups(), PrefixTree(), []
    two = 1 in sides

    def probe(i):
        mark[parts[i]] = True
        for j in tree.walk(parts[i], mark, num, den):
            if groups.find(roots[i]) != groups.find(roots[j]):
                groups.union(roots[i], roots[j])
                out.append((docs[i], docs[j]))
        mark[parts[i]] = False

    for i in range(len(sets)):
        if sides[i] == 0:
            if not two:
                probe(i)
            tree.insert(parts[i], i)
    for i in range(len(sets)) if two else ():
        if sides[i] == 1:
            probe(i)
    return out


_KEYS = 3


def _packed_of(k: int, order, wanted):
    """(rep, keys) of rows whose doc_id may be wanted, so that the join after moves few sets: distinct numbers that rise
    in the global order from its end (the level, then the hash, both falling)."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            few = batch.filter(pa.array(known & has(wanted.value, mix(ids.fill_null(0).to_numpy().view(np.uint64)))))
            for lo in range(0, len(few), 1000):
                keys = []
                for _, s in shingle_sets(few.column(1).slice(lo, 1000), k):
                    key = (np.uint64(3) - order.value.levels(s).astype(np.uint64)) << np.uint64(62) | ~s >> np.uint64(2)
                    keys.append(np.unique(key).tobytes())
                yield pa.RecordBatch.from_arrays([few.column(0).slice(lo, 1000), pa.array(keys, pa.binary())], ["rep", "keys"])

    return run


def packed_sets(docs: DataFrame, ids: DataFrame, k: int, order) -> DataFrame:
    """(rep, keys) of docs whose doc_id is among ids (and of some more)."""
    bits = bits_for(ids.count(), BITS_EACH, MOST_ONCE)
    wanted = docs.sparkSession.sparkContext.broadcast(build(ids.mapInArrow(_ids, SCHEMA), bits, once=True, again=False)[0])
    return docs.mapInArrow(_packed_of(k, order, wanted), "rep long, keys binary")


def _joined_of(num: int, den: int):
    """Rows (comp, i, j, side, rep, root, keys) come sorted by comp, i and j; a task holds one pair of blocks at a time."""

    def run(batches):
        now, rows = None, []
        for batch in batches:
            *key, side, rep, root = (batch.column(c).to_pylist() for c in range(_KEYS + 3))
            for r, at in enumerate(zip(*key, strict=True)):
                if at != now:
                    if len(rows) > 1 and (out := join_block(*zip(*rows, strict=True), num, den)):
                        yield _links(out)
                    now, rows = at, []
                rows.append((side[r], rep[r], root[r], np.frombuffer(batch.column(_KEYS + 3)[r].as_buffer(), np.uint64)))
        if len(rows) > 1 and (out := join_block(*zip(*rows, strict=True), num, den)):
            yield _links(out)

    return run


def _links(out) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """One row (doc_id, n_shingles, component_id) for each row of docs; component_id is the smallest doc_id linked."""
    if not 0 < num <= den:
        raise ValueError("the threshold must be over 0 and 1 at most")
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    slim = docs.select(F.col("doc_id").cast("long"), "text")
    all_nodes = scratch.write(slim.mapInArrow(_nodes_of(k), "doc_id long, n int, f1 long, f2 long"), "nodes")
    reps = all_nodes.where("n > 0 and doc_id is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    named = scratch.write(all_nodes.join(reps.drop("n"), ["f1", "f2"], "left").select("doc_id", "n", "rep"), "named")
    order = spark.sparkContext.broadcast(global_order(slim, k, 2 * (den - num) / den + 0.02))

    tokens = slim.mapInArrow(_prefix_of(k, num, den, order), "h long, n int, doc_id long")
    chains = tokens.repartition("h").sortWithinPartitions("h", "n", "doc_id").mapInArrow(_chains_of(num, den), "a long, b long").distinct()
    to_rep = named.where("rep is not null").select("doc_id", "rep").distinct()
    edges = chains.join(to_rep.toDF("a", "ra"), "a").join(to_rep.toDF("b", "rb"), "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
    coarse_edges = scratch.write(connected_components(edges), "coarse")
    coarse = coarse_edges.withColumnRenamed("component", "comp")

    sizes = named.where("rep = doc_id").groupBy("rep").agg(F.min("n").alias("n"))
    sized = scratch.write(coarse.withColumnRenamed("node", "rep").join(sizes, "rep").select("comp", "n", "rep"), "sized")
    rows = sized.repartitionByRange("comp", "n", "rep").sortWithinPartitions("comp", "n", "rep")
    # a row's number rises with comp, size and rep, and has 33 bits for each task, which blocks therefore don't cross
    most = F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.pow(F.lit(2), F.floor(F.log2(F.lit(BLOCK_SHINGLES) / F.col("n")))).cast("long")))
    number = F.monotonically_increasing_id()
    dealt = scratch.write(rows.withColumn("number", number).select("comp", (F.col("number") - F.pmod("number", most)).alias("blk"), "rep", "n"), "blocks")
    few = packed_sets(slim, dealt.select("rep"), k, order)
    sets = scratch.write(few.join(dealt.select("comp", "blk", "rep"), "rep").select("comp", "blk", "rep", "keys"), "sets")

    def joined(rows):
        rows = rows.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "side", "rep")
        return rows.mapInArrow(_joined_of(num, den), "a long, b long")

    within = joined(sets.select("comp", F.col("blk").alias("i"), F.col("blk").alias("j"), F.lit(0).alias("side"), "rep", F.col("rep").alias("root"), "keys"))
    links = scratch.write(within, "links")
    found = scratch.write(connected_components(links), "found")

    many = dealt.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("component", "rep"))
    blocks = many.groupBy("comp", "blk").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("root").alias("r1"), F.max("root").alias("r2"))
    blocks = scratch.write(blocks, "summary")
    if blocks.groupBy("comp").agg(F.count("*").alias("n")).where("n > 1").take(1):
        left, right = blocks.alias("x"), blocks.alias("y")
        apart = F.expr("not (x.r1 = x.r2 and y.r1 = y.r2 and x.r1 = y.r1)")
        pairs = left.join(right, F.expr(f"x.comp = y.comp and x.blk < y.blk and x.most * {den}L >= y.least * {num}L") & apart)
        pairs = scratch.write(pairs.select("x.comp", F.col("x.blk").alias("i"), F.col("y.blk").alias("j")), "pairs")
        rooted = sets.join(many.select("rep", "root").distinct(), "rep")
        sides = [rooted.join(pairs.withColumn("blk", F.col(c)), ["comp", "blk"]).select("comp", "i", "j", F.lit(s).alias("side"), "rep", "root", "keys") for s, c in enumerate(("i", "j"))]
        links = links.union(scratch.write(joined(sides[0].union(sides[1])), "across"))
        found = scratch.write(connected_components(links), "found")
        scratch.drop(pairs)
    scratch.drop(all_nodes, coarse_edges, sized, dealt, sets, blocks)
    grouped = named.join(found.toDF("rep", "component"), "rep", "left")
    own = F.when(F.col("rep").isNotNull(), F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    return grouped.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 3, 90, 100)
