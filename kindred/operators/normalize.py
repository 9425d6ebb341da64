"""Names by first occurrence, statements by delimiters and bracket depths, as window expressions over token rows.

Rows are (key, pos, tok). Each step is a window within one key: one shuffle, and a sort that spills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positional_names(tokens: DataFrame, key: str, keep: Column, prefix: str = "$V") -> DataFrame:
    """Adds norm: the n-th distinct token of a key becomes prefix n, from 0 by first occurrence; kept ones stay."""
    held = tokens.withColumn("_keep", keep)
    first = held.withColumn("_first", F.min("pos").over(Window.partitionBy(key, "tok")))
    place = F.dense_rank().over(Window.partitionBy(key, "_keep").orderBy("_first")) - 1
    return first.withColumn("norm", F.when(F.col("_keep"), F.col("tok")).otherwise(F.concat(F.lit(prefix), place.cast("string")))).drop("_keep", "_first")


def positional_names_by_kind(tokens: DataFrame, key: str, kind: str, prefixes: dict[str, str]) -> DataFrame:
    """As positional_names, with a counter for each kind; a name keeps the kind of its first occurrence."""
    by = Window.partitionBy(key, "tok")
    first = tokens.withColumns({"_first": F.min("pos").over(by), "_kind": F.min_by(kind, "pos").over(by)})
    place = F.dense_rank().over(Window.partitionBy(key, "_kind").orderBy("_first")) - 1
    name = F.col("tok")
    for k, p in prefixes.items():
        name = F.when(F.col("_kind") == k, F.concat(F.lit(p), place.cast("string"))).otherwise(name)
    return first.withColumn("norm", name).drop("_first", "_kind")


def statement_ids(tokens: DataFrame, key: str, delimiter: Column) -> DataFrame:
    """Adds stmt: the number of delimiters before a token, so that a delimiter ends its own statement."""
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return tokens.withColumn("stmt", F.coalesce(F.sum(delimiter.cast("long")).over(before), F.lit(0)))


def bracket_depths(tokens: DataFrame, key: str, opening: str, closing: str) -> DataFrame:
    """Adds depth: openings less closings up to and with each token."""
    step = F.when(F.col("tok") == opening, 1).when(F.col("tok") == closing, -1).otherwise(0)
    return tokens.withColumn("depth", F.sum(step).over(Window.partitionBy(key).orderBy("pos")))
