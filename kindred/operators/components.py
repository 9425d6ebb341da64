"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.plans.storage import Scratch

#: Edges that one task joins in memory; more are joined in distributed rounds. The result is the same.
FEW = 1 << 18


def _joined(batches):
    up: dict[int, int] = {}

    def find(x):
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p]
        return x

    for batch in batches:
        for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            u, v = find(u), find(v)
            if u != v:
                up[max(u, v)] = min(u, v)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "component"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, few: int = FEW) -> DataFrame:
    """One row (node, component) for each node that an edge names; component is the smallest node reachable.

    Each round is two aggregations joined back on their key, so a node with very many edges is split by adaptive
    skew handling and pre-aggregated before the shuffle. Rounds are written tables: a lost executor costs a task, not
    the history. The number of rounds grows with the logarithm of the longest path. Rows with a null end are ignored,
    self-loops yield their own node, repeated edges count once.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    base = scratch.write(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if base.count() <= few:
        return base.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(_joined, "node long, component long")
    nodes = base.select(F.col("u").alias("node")).union(base.select("v")).distinct()
    now, last = base.where("u <> v"), None
    held = []
    for _ in range(max_rounds):
        out = scratch.write(_small(_large(now)), "round")
        mark = out.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if held:
            scratch.drop(held.pop())
        held.append(out)
        now = out
        if tuple(mark) == last:
            break
        last = tuple(mark)
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    root = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.join(root, "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v"), F.col("u")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    far = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return far.where("u <> v").distinct()


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(least).distinct()
