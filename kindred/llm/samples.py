"""Bounded samples of rows to fit classifiers on, the same at each run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo the number of folds."""
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(folds))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(remainder(doc_id, folds) == fold, F.lit(False))


def known_labels(labels: DataFrame, label: str, folds: int, fold: int) -> DataFrame:
    """(doc_id, y) of the rows to learn from; of several labels of a document the largest counts."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
    return rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))


def at_most(ids: DataFrame, most: int, seed: int) -> DataFrame:
    """`most` distinct rows at most, those of the lowest seeded hashes of doc_id.

    Rows are taken by a bound on the hash, four times as many as are wanted, before repeated ones are dropped: so what
    is shuffled and sorted doesn't grow with the table.
    """
    rows = ids.count()
    hashed = ids.withColumn("_hash", F.xxhash64("doc_id", F.lit(seed)))
    if rows > 4 * most:
        hashed = hashed.where(F.col("_hash") <= -(2**63) + int(2**64 * 4 * most / rows))
    return hashed.distinct().orderBy("_hash", "doc_id").limit(most).drop("_hash")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, y, text) of a bounded sample of ids, one text of each (the smallest); the bound makes it small enough to broadcast."""
    found = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def free_names(columns: list[str], names: list[str]) -> list[str]:
    """Names for added columns: a name that the input has already gets another underscore."""
    out = []
    for name in names:
        while name.lower() in {c.lower() for c in columns}:
            name = "_" + name
        out.append(name)
    return out
