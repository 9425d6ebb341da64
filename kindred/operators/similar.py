"""All pairs of documents whose sets of word shingles are similar, exact, and without a pair for each shingle they share.

A document's set is its distinct runs of k tokens (kindred.functions.text.tokens); a and b are a pair when
den * |intersection| >= num * |union|. Documents of fewer tokens have no set and are in no pair.

1. Equal sets are one node, named by its smallest doc_id; only the result expands copies into pairs.
2. Shingles of one node first, then those of few, then of many (told by filters, see functions/filters.py), then by
   hash: that is one order for all sets. Similar sets share one of the first n - ceil(n * num / den) + 1 of either, and
   one that a single node has is shared with none. So most documents name no shingle at all.
3. The nodes that name a shingle, sorted by the sizes of their sets, are chained to their neighbours, but not where the
   sizes alone rule out a pair: rows in proportion to the nodes, not to their square. Components of chains hold all pairs.
4. A component's sets, sorted by size, are dealt into blocks, and blocks are joined with each other unless sizes rule out
   all their pairs. A pair of blocks counts all its intersections at once, as a product of matrices.

Shingles are 64-bit hashes, nodes 128-bit hashes of sets. A doc_id on several rows has the shingles of each, one that
two rows have twice, as a join of exploded rows would count them; its pairs come from such a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import text as T
from kindred.functions.filters import MOST_ONCE, SCHEMA, bits_for, build, has, packed
from kindred.functions.words import freed, longs, mix, sliced, word_bytes
from kindred.operators.components import connected_components
from kindred.plans.storage import Scratch

#: A shingle is frequent from about so many nodes on.
OFTEN = 32
#: Bits of a filter for each shingle (of which some alone are then taken for shared), and for each document.
SHINGLE_BITS, BITS_EACH = 4, 8
#: Sets in a block (a power of two), and about the shingles from which on a block has fewer sets.
BLOCK, BLOCK_SHINGLES = 256, 1 << 18
#: Shingles that a product of matrices takes at a time.
COLUMNS = 4096
#: About the documents in one row of a node's members.
MEMBERS = 256
#: About the hashes that are packed at a time.
PACKED = 1 << 19

_KIND = word_bytes(b" \t\n\r")
_SALT = (np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3))


def shingle_sets(column: pa.Array, k: int):
    """Of the rows of each slice that have a set: their numbers, the sorted sets behind each other, and where each begins."""
    for lo, hi, w in sliced(column, _KIND, False):
        h, first = w.grams(k), w.first
        rows = np.flatnonzero(np.diff(first) >= k)
        if len(rows):
            sets = [np.unique(h[first[r] : first[r + 1] - k + 1]) for r in rows]
            yield lo + rows, np.concatenate(sets), np.cumsum([0, *map(len, sets)])


def _nodes_of(k: int):
    def run(batches):
        for batch in freed(batches):
            for rows, flat, at in shingle_sets(batch.column(1), k):
                f = [longs(np.add.reduceat(mix(flat ^ s), at[:-1])) for s in _SALT]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.diff(at).astype(np.int32)), *f], ["doc_id", "n", "f1", "f2"])

    return run


def _ids(batches):
    for batch in batches:
        yield packed(mix(batch.column(0).to_numpy().view(np.uint64)))


def _filter_of(ids: DataFrame, count: int):
    """A broadcast filter of some numbers of documents."""
    built = build(ids.mapInArrow(_ids, SCHEMA), bits_for(count, BITS_EACH, MOST_ONCE), once=True, again=False)
    return ids.sparkSession.sparkContext.broadcast(built[0])


def _only(batch: pa.RecordBatch, wanted: np.ndarray) -> pa.RecordBatch:
    """The rows whose doc_id is in a filter: all that it was built from, and a few more."""
    return batch.filter(pa.array(has(wanted, mix(batch.column(0).to_numpy().view(np.uint64)))))


def _packed_of(k: int, wanted):
    def run(batches):
        held, n = [], 0
        for batch in freed(batches):
            for _, flat, _ in shingle_sets(_only(batch, wanted.value).column(1), k):
                held.append(flat)
                n += len(flat)
                if n >= PACKED:
                    yield packed(np.concatenate(held))
                    held, n = [], 0
        if held:
            yield packed(np.concatenate(held))

    return run


def levels(h: np.ndarray, again: np.ndarray, many: np.ndarray) -> np.ndarray:
    """0: of one node; 1: of some; 2: of many."""
    out = has(again, h).astype(np.uint8)
    at = np.flatnonzero(out)
    out[at[has(many, h[at])]] = 2
    return out


def _prefix_of(k: int, num: int, den: int, wanted, filters):
    """(h, n, doc_id): of the first shingles of each set in the order of all, those that other nodes may have."""

    def run(batches):
        for batch in freed(batches):
            batch = _only(batch, wanted.value)
            ids = batch.column(0).to_numpy()
            for rows, flat, at in shingle_sets(batch.column(1), k):
                level, n = levels(flat, *filters.value), np.diff(at)
                first = n - -(-n * num // den) + 1
                alone = np.add.reduceat((level == 0).astype(np.int64), at[:-1])
                got = [np.zeros(0, np.uint64)]
                left = np.maximum(first - alone, 0)
                for i in np.flatnonzero(left):
                    s, of = flat[at[i] : at[i + 1]], level[at[i] : at[i + 1]]
                    s, of = s[of > 0], of[of > 0]
                    got.append(s[np.argsort(of, kind="stable")][: left[i]])
                yield pa.RecordBatch.from_arrays([longs(np.concatenate(got)), pa.array(np.repeat(n, left).astype(np.int32)), pa.array(np.repeat(ids[rows], left))], ["h", "n", "doc_id"])

    return run


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
            ok = (h[1:] == h[:-1]) & (n[:-1].astype(np.int64) * den >= n[1:].astype(np.int64) * num)
            pairs = np.unique(np.stack([ids[:-1][ok], ids[1:][ok]], 1), axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _keys_of(k: int, wanted):
    def run(batches):
        for batch in freed(batches):
            batch = _only(batch, wanted.value)
            for rows, flat, at in shingle_sets(batch.column(1), k):
                keys = [flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(keys, pa.binary())], ["rep", "keys"])

    return run


def overlaps(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Sizes of the intersections of the first `left` sets with the others, or if there are none, with each other (what a
    set shares with itself alone isn't counted)."""
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(n > 1) - 1  # those of one set play no part
    row, kept = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), n[at] > 1
    row, at = row[kept], number[at[kept]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    out = np.zeros((left, len(sets) - left or left), np.int64)
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        a, b = np.searchsorted(at, [lo, lo + COLUMNS])
        m = np.zeros((len(sets), int(at[b - 1]) - lo + 1), np.float32)
        m[row[a:b], at[a:b] - lo] = 1
        out += (m[:left] @ (m[left:] if left < len(sets) else m).T).astype(np.int64)
    return out


def _linked(rows: list[tuple], num: int, den: int) -> pa.RecordBatch:
    """Pairs of a block, or where side 1 occurs, of one block with another; rows: (side, rep, set), sorted."""
    rep, sets = np.array([r[1] for r in rows], np.int64), [r[2] for r in rows]
    n, left = np.array([len(s) for s in sets], np.int64), sum(r[0] == 0 for r in rows)
    within = left == len(rows)
    inter = overlaps(sets, left) if 0 < left and (not within or left > 1) else np.zeros((left, 0), np.int64)
    ok = (inter > 0) & (den * inter >= num * (n[:left, None] + (n if within else n[left:])[: inter.shape[1]] - inter))
    i, j = np.nonzero(np.triu(ok, 1) if within else ok)
    both, inter = (i, j if within else j + left), inter[i, j]
    return pa.RecordBatch.from_arrays([*(pa.array(rep[x]) for x in both), pa.array(inter), *(pa.array(n[x]) for x in both)], ["a", "b", "inter", "na", "nb"])


def _joined_of(num: int, den: int):
    """Rows (comp, i, j, side, rep, keys) come sorted by comp, i and j; a task holds one pair of blocks at a time."""

    def run(batches):
        now, rows = None, []
        for batch in batches:
            comp, i, j, side, rep = (batch.column(c).to_pylist() for c in range(5))
            for r, at in enumerate(zip(comp, i, j, strict=True)):
                if at != now:
                    if rows:
                        yield _linked(rows, num, den)
                    now, rows = at, []
                rows.append((side[r], rep[r], np.frombuffer(batch.column(5)[r].as_py(), np.uint64)))
        if rows:
            yield _linked(rows, num, den)

    return run


def _node_pairs(scratch: Scratch, docs: DataFrame, reps: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b, inter, na, nb) of nodes; docs: (doc_id, text) in lower case, of each node at least its first document."""
    spark = docs.sparkSession
    count, shingles = reps.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    wanted = _filter_of(reps.select("rep"), count)
    filters = spark.sparkContext.broadcast(build(docs.mapInArrow(_packed_of(k, wanted), SCHEMA), bits_for(shingles, SHINGLE_BITS), often=OFTEN))
    tokens = docs.mapInArrow(_prefix_of(k, num, den, wanted, filters), "h long, n int, doc_id long")
    edges = tokens.repartition("h").sortWithinPartitions("h", "n", "doc_id").mapInArrow(_chains_of(num, den), "a long, b long").distinct()
    comps = connected_components(edges).toDF("rep", "comp")

    sized = scratch.write(comps.join(reps.select("rep", "n"), "rep").select("comp", "n", "rep"), "sized")
    rows = sized.repartitionByRange("comp", "n", "rep").sortWithinPartitions("comp", "n", "rep")
    # a row's number rises with comp, size and rep, and has 33 bits for each task, which blocks therefore don't cross
    most = F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.pow(F.lit(2), F.floor(F.log2(F.lit(BLOCK_SHINGLES) / F.col("n")))).cast("long")))
    rows = rows.withColumn("number", F.monotonically_increasing_id())
    dealt = scratch.write(rows.select("comp", (F.col("number") - F.pmod("number", most)).alias("blk"), "rep", "n"), "blocks")

    keys = docs.mapInArrow(_keys_of(k, _filter_of(dealt.select("rep"), dealt.count())), "rep long, keys binary")
    sets = scratch.write(keys.join(dealt, "rep").select("comp", "blk", "rep", "keys"), "sets")
    blocks = scratch.write(dealt.groupBy("comp", "blk").agg(F.min("n").alias("least"), F.max("n").alias("most")), "summary")
    x, y = blocks.alias("x"), blocks.alias("y")
    pairs = scratch.write(x.join(y, F.expr(f"x.comp = y.comp and x.blk < y.blk and x.most * {den}L >= y.least * {num}L")).select("x.comp", F.col("x.blk").alias("i"), F.col("y.blk").alias("j")), "pairs")
    sides = [sets.join(pairs.withColumn("blk", F.col(c)), ["comp", "blk"]).select("comp", "i", "j", F.lit(s).alias("side"), "rep", "keys") for s, c in enumerate(("i", "j"))]
    within = sets.select("comp", F.col("blk").alias("i"), F.col("blk").alias("j"), F.lit(0).alias("side"), "rep", "keys")
    rows = within.union(sides[0]).union(sides[1]).repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "side", "rep")
    links = scratch.write(rows.mapInArrow(_joined_of(num, den), "a long, b long, inter long, na long, nb long"), "links")
    scratch.drop(sized, dealt, sets, blocks, pairs)
    return links


def _expanded(scratch: Scratch, nodes: DataFrame, reps: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs of documents from those of nodes, and the pairs of each node's copies."""
    copied = reps.where("m > 1").withColumn("parts", F.ceil(F.col("m") / MEMBERS))
    members = nodes.join(copied, ["f1", "f2", "n"]).withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts"))
    lists = scratch.write(members.groupBy("rep", "n", "part").agg(F.collect_list("doc_id").alias("docs")), "members")

    of = lists.select("rep", "docs")
    found = links.join(of.toDF("a", "da"), "a", "left").join(of.toDF("b", "db"), "b", "left")
    found = found.withColumn("da", F.coalesce("da", F.array("a"))).withColumn("db", F.coalesce("db", F.array("b")))
    x, y = lists.alias("x"), lists.alias("y")
    copies = x.join(y, F.expr("x.rep = y.rep and x.part <= y.part")).select(F.col("x.rep").alias("rep"), F.col("x.part").alias("p"), F.col("y.part").alias("q"), F.col("x.n").cast("long").alias("n"), F.col("x.docs").alias("da"), F.col("y.docs").alias("db"))
    copies = copies.repartition("rep", "p", "q")  # a group's pairs are many tasks' work
    copies = copies.select("p", "q", "n", F.explode("da").alias("x"), "db").select("p", "q", "n", "x", F.explode("db").alias("y")).where("p < q or x < y")
    found = found.select("inter", "na", "nb", F.explode("da").alias("x"), "db").select("inter", "na", "nb", "x", F.explode("db").alias("y"))
    out = found.select("x", "y", "inter", "na", "nb").union(copies.select("x", "y", "n", "n", "n"))
    return out.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "inter", "na", "nb")


def _of_repeated(docs: DataFrame, repeated: DataFrame, k: int) -> DataFrame:
    """(a, b, inter, na, nb) of the documents that share a shingle, one of them with several rows."""
    sets = T.held(T.held(docs, "t", T.tokens(F.col("text"))).select("doc_id", "t"), "sh", T.shingles(F.col("t"), k))
    bags = sets.select("doc_id", F.explode("sh").alias("h")).groupBy("doc_id", "h").agg(F.count("*").alias("c"))
    bags = bags.join(repeated.withColumn("more", F.lit(True)), "doc_id", "left").withColumn("more", F.coalesce("more", F.lit(False)))
    n = bags.groupBy("doc_id").agg(F.sum("c").alias("n"))
    x, y = bags.where("more").alias("x"), bags.alias("y")
    both = x.join(y, F.expr("x.h = y.h and (x.doc_id < y.doc_id or not y.more and x.doc_id > y.doc_id)"))
    both = both.groupBy(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).agg(F.sum(F.col("x.c") * F.col("y.c")).alias("inter"))
    return both.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b").select("a", "b", "inter", "na", "nb")


def similar_pairs(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b, inter, similarity) of all pairs a < b of doc_id; docs: (doc_id, text). Rows with a null doc_id are in no pair."""
    if not 0 < num <= den:
        raise ValueError("the threshold must be over 0 and 1 at most")
    scratch = Scratch(docs.sparkSession, "similar")
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    more = bool(repeated.take(1))
    single = (docs.join(repeated, "doc_id", "left_anti") if more else docs).select("doc_id", F.lower("text").alias("text"))

    nodes = scratch.write(single.mapInArrow(_nodes_of(k), "doc_id long, n int, f1 long, f2 long"), "nodes")
    reps = scratch.write(nodes.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m")), "reps")
    out = _expanded(scratch, nodes, reps, _node_pairs(scratch, single, reps, k, num, den))
    if more:
        out = out.union(_of_repeated(docs, repeated, k))
    union = F.col("na") + F.col("nb") - F.col("inter")
    return out.where(F.try_divide(F.col("inter").cast("double"), union.cast("double")) >= num / den).select("a", "b", "inter", (F.col("inter") / union).alias("similarity"))
