"""Classes of equal units by hash, and of similar ones by MinHash, bands, exact Jaccard and components."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.config import Config
from kindred.functions import family
from kindred.functions import text as T
from kindred.operators.components import connected_components
from kindred.plans.storage import Scratch

_INTERVALS = "array<struct<start_line:int,unit_idx:bigint,end_line:int>>"


def greedy_intervals(sorted_: Column) -> Column:
    """Of intervals sorted by start, those that don't overlap the one kept before; a strictly wider one takes its place.

    An interval is compared with the end of the kept one, not of all so far, so this is not gaps-and-islands.
    """

    def step(kept: Column, x: Column) -> Column:
        last = F.element_at(kept, -1)
        wider = x["end_line"] - x["start_line"] > last["end_line"] - last["start_line"]
        instead = F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(x))
        return F.when((F.size(kept) == 0) | (x["start_line"] > last["end_line"]), F.concat(kept, F.array(x))).when(wider, instead).otherwise(kept)

    def step_or_first(kept: Column, x: Column) -> Column:
        return F.when(F.size(kept) == 0, F.array(x)).otherwise(step(kept, x))

    return F.aggregate(sorted_, F.array().cast(_INTERVALS), step_or_first)


def without_overlaps(units: DataFrame, group: str) -> DataFrame:
    """(group, unit_idx) of the units left in each group once overlaps within a function are resolved."""
    at = F.struct("start_line", "unit_idx", "end_line")
    kept = units.groupBy(group, "file", "func_name").agg(greedy_intervals(F.array_sort(F.collect_list(at))).alias("kept"))
    return kept.select(group, F.explode("kept.unit_idx").alias("unit_idx"))


def exact_members(units: DataFrame) -> DataFrame:
    """(class_id, unit_idx) of groups of two or more equal units; class_id is the smallest unit_idx."""
    kept = without_overlaps(units, "token_hash")
    groups = kept.groupBy("token_hash").agg(F.count("*").alias("n"), F.min("unit_idx").alias("class_id")).where("n >= 2")
    return kept.join(groups, "token_hash").select("class_id", "unit_idx")


def unmatched(units: DataFrame, members: DataFrame) -> DataFrame:
    """Units in no class, with those that overlap resolution has dropped."""
    return units.join(members, "unit_idx", "left_anti")


def _portable(tokens: list[str], kinds: list[int] | None, n: int, known: dict) -> list[int]:
    out = []
    for x in dict.fromkeys(" ".join(tokens[i : i + n]) for i in range(len(tokens) - n + 1)):
        if (h := known.get(x)) is None:
            h = known[x] = int.from_bytes(md5(x.encode()).digest()[:8], "big") >> 4
        out.append(h)
    return out


def _shingled_of(n: int, at: int, kinds_at: int | None, hashes):
    """Shingles in Arrow batches. Windows of one document share most of their runs, so each run is hashed once a batch."""

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part, known, flat, ends = batch.slice(lo, 1024), {}, [], [0]
                kinds = [None] * len(part) if kinds_at is None else part.column(kinds_at).to_pylist()
                for tokens, of in zip(part.column(at).to_pylist(), kinds, strict=True):
                    flat += hashes(tokens, of, n, known)
                    ends.append(len(flat))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
                has = np.diff(ends) > 0
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*batch.schema.names, "shingles"]).filter(pa.array(has))

    return run


def with_shingles(units: DataFrame, cfg: Config) -> DataFrame:
    """units that have shingles, with their distinct hashes: 60 bits that SQL can check, or those of kindred.functions.family,
    which take each token's kind from the column kinds, if there is one."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema)
    names, exact = units.columns, cfg.hash_family == "fnv"
    kinds_at = names.index("kinds") if exact and "kinds" in names else None
    run = _shingled_of(cfg.shingle_size, names.index("tokens"), kinds_at, family.shingle_hashes if exact else _portable)
    return units.mapInArrow(run, f"{fields}, shingles array<bigint>")


def _signed_of(k: int, at: int):
    a, b = (np.array(x, np.int64) for x in T.factors(k))

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                lists = part.column(at)
                bounds = lists.offsets.to_numpy()
                s = lists.values.to_numpy()[bounds[0] : bounds[-1]] % T.PRIME
                sig = np.stack([np.minimum.reduceat((x * s + y) % T.PRIME, bounds[:-1] - bounds[0]) for x, y in zip(a, b, strict=True)], 1)
                flat = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * k, sig.ravel())
                yield pa.RecordBatch.from_arrays([*part.columns, flat], [*batch.schema.names, "sig"])

    return run


def signatures(shingled: DataFrame, k: int) -> DataFrame:
    """Adds sig: k minima of permuted shingles, which must not be empty. In numpy: as a lambda in a lambda, the JVM takes
    some hundred times as long for each step."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shingled.schema)
    return shingled.mapInArrow(_signed_of(k, shingled.columns.index("shingles")), f"{fields}, sig array<bigint>")


def _bucketed_of(cfg: Config, at: int):
    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                lists = part.column(at)
                bounds = lists.offsets.to_numpy()
                sig = family.minima(lists.values.to_numpy()[bounds[0] : bounds[-1]], bounds - bounds[0], cfg.hashes)
                flat = family.band_hashes(sig, cfg.bands, cfg.rows)
                out = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * cfg.bands, flat.ravel())
                yield pa.RecordBatch.from_arrays([*part.columns, out], [*batch.schema.names, "buckets"])

    return run


def bands(shingled: DataFrame, cfg: Config) -> DataFrame:
    """(unit_idx, file, func_name, start_line, end_line, n_shingles, band, bucket); a bucket is a digest of its band's minima."""
    if cfg.hash_family == "fnv":
        slim = shingled.select("unit_idx", "file", "func_name", "start_line", "end_line", "shingles")
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema)
        found = slim.mapInArrow(_bucketed_of(cfg, slim.columns.index("shingles")), f"{fields}, buckets array<bigint>")
        return found.select("unit_idx", "file", "func_name", "start_line", "end_line", F.size("shingles").alias("n_shingles"), F.posexplode("buckets").alias("band", "bucket"))
    signed = signatures(shingled.select("unit_idx", "file", "func_name", "start_line", "end_line", "shingles"), cfg.hashes)
    each = F.transform(F.sequence(F.lit(0), F.lit(cfg.bands - 1)), lambda b: F.struct(b.alias("band"), F.unhex(F.md5(F.array_join(F.slice("sig", b * cfg.rows + 1, cfg.rows), ","))).alias("bucket")))
    return signed.select("unit_idx", "file", "func_name", "start_line", "end_line", F.size("shingles").alias("n_shingles"), F.explode(each).alias("x")).select("*", "x.band", "x.bucket").drop("x")


def candidates(banded: DataFrame, least: float = 0.0) -> DataFrame:
    """Distinct pairs a < b that share a bucket and don't overlap within one function.

    least: a similarity that pairs must be able to reach by their numbers of shingles alone. Rows without a partner in
    their bucket are dropped before the join, and the rest is written, as both of its sides read it.
    """
    scratch = Scratch(banded.sparkSession, "bands")
    banded = scratch.write(banded, "all")
    shared = banded.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1").select("band", "bucket")
    banded = scratch.write(banded.join(shared, ["band", "bucket"]), "shared")
    a, b = banded.alias("a"), banded.alias("b")
    overlap = F.expr("a.file = b.file and a.func_name = b.func_name and a.start_line <= b.end_line and b.start_line <= a.end_line")
    near = F.least("a.n_shingles", "b.n_shingles") >= least * F.greatest("a.n_shingles", "b.n_shingles")
    pairs = a.join(b, F.expr("a.band = b.band and a.bucket = b.bucket and a.unit_idx < b.unit_idx") & near & ~overlap)
    return pairs.select(F.col("a.unit_idx").alias("a"), F.col("b.unit_idx").alias("b")).distinct()


def verified(pairs: DataFrame, shingled: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of the pairs whose exact Jaccard similarity reaches the threshold."""
    sets = shingled.select("unit_idx", "shingles")
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    # the sizes alone bound the similarity
    both = both.where(F.least(F.size("sa"), F.size("sb")) >= least * F.greatest(F.size("sa"), F.size("sb")))
    return both.select("a", "b", T.jaccard(F.col("sa"), F.col("sb")).alias("similarity")).where(F.col("similarity") >= least)


def near_classes(pairs: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes (class_id, similarity) of components of verified pairs, and their members (class_id, unit_idx)."""
    labels = connected_components(pairs)
    mean = pairs.join(labels.toDF("a", "component"), "a").groupBy("component").agg(F.least(F.round(F.avg("similarity"), 9), F.lit(1.0)).alias("similarity"))
    kept = without_overlaps(labels.withColumnRenamed("node", "unit_idx").join(units, "unit_idx"), "component")
    groups = kept.groupBy("component").agg(F.count("*").alias("n"), F.min("unit_idx").alias("class_id")).where("n >= 2")
    classes = groups.join(mean, "component")
    return classes.select("class_id", "similarity"), kept.join(groups, "component").select("class_id", "unit_idx")
