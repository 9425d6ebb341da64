"""A corpus pipeline of five stages, each an operator of kindred.llm over all that the stage before has kept.

toxicity      documents that the classifier calls toxic (a score of THRESHOLD or more, as in op1_toxicity) go
near_copies   of each group of near duplicates (five-word shingles, similarity 0.8) the row of the smallest doc_id stays
substrings    words in passages of PASSAGE words that start earlier in the corpus are taken out of the texts
benchmark     words in matches with benchmark items are taken out of the texts, and the whole text where they are most of it
encode        every text is encoded by byte-level BPE and decoded again

All stages but the last return the columns of documents; where a text changes, n_chars follows it. Each row is a document,
also one with a null doc_id or one that other rows have too: the near-copy and substring stages go by a number of each
row's own, which rises with doc_id (nulls last; of rows with one doc_id, by a hash of the text). A stage's result is
written and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.bpe import bpe_round_trip, default_path
from kindred.llm.decontaminate import contamination
from kindred.llm.jaccard_join import jaccard_components
from kindred.llm.substring_dedup import substring_dedup
from kindred.llm.toxicity import THRESHOLD, toxicity_scores
from kindred.plans.storage import Scratch

PASSAGE = 20
SHINGLE, SIMILAR = 5, (80, 100)


def _plain(docs: DataFrame) -> DataFrame:
    """docs with names that clash with none an operator adds; doc_id, text and n_chars keep theirs. _as() gives all back."""
    return docs.toDF(*(c if c in ("doc_id", "text", "n_chars") else f"c{i}" for i, c in enumerate(docs.columns)))


def _as(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*_plain(docs).columns).toDF(*docs.columns)


def _with_text(out: DataFrame, docs: DataFrame, changed, text) -> DataFrame:
    """The rows with another text, and n_chars of it, where a condition holds."""
    out = out.withColumn("_new", F.when(changed, text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("_new").cast("long")).otherwise(F.col("n_chars")))
    return _as(out.withColumn("text", F.col("_new")), docs)


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with doc_id a number of each row's own, in the order of the doc_id before, which is kept as _doc_id.

    Where each row has a doc_id of its own that is the number. Otherwise rows are sorted, numbered and written, so that
    each reading finds the same numbers.
    """
    if not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id is null or n > 1").take(1):
        return docs.withColumn("_doc_id", F.col("doc_id"))
    rows = docs.withColumnRenamed("doc_id", "_doc_id").withColumn("_at", F.monotonically_increasing_id())
    rows = rows.orderBy(F.col("_doc_id").asc_nulls_last(), F.xxhash64("text"), "_at").drop("_at")
    return Scratch(docs.sparkSession, "rows").write(rows.withColumn("doc_id", F.monotonically_increasing_id()), "rows")


def _unnumbered(rows: DataFrame) -> DataFrame:
    return rows.drop("doc_id").withColumnRenamed("_doc_id", "doc_id")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = toxicity_scores(_plain(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _as(out.where(F.col("_score") < THRESHOLD), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _numbered(_plain(docs))
    groups = jaccard_components(rows, SHINGLE, *SIMILAR)
    gone = groups.where("component_id <> doc_id").select("doc_id")
    return _as(_unnumbered(rows.join(gone, "doc_id", "left_anti")), docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = _unnumbered(substring_dedup(_numbered(_plain(docs)), PASSAGE))
    return _with_text(out, docs, F.col("_n_removed") > 0, F.col("_kept"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = contamination(_plain(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), clean=True)
    return _with_text(out, docs, F.col("_n_hit") > 0, F.col("_clean"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe_round_trip(docs.select("doc_id", "text"), default_path(), digest=True)
    return out.select("doc_id", F.col("_n_tokens").alias("n_tokens"), F.col("_ids").alias("ids_sha256"), F.col("_decoded").alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("near_copies", near_copies), ("substrings", substrings), ("benchmark", benchmark), ("encode", encode)]

#: The classifier, the tokenizer and the removal of passages are beyond SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
