"""Shuffled shards by a two-pass external shuffle, with Spark expressions only.

Pass 1 scatters rows into buckets by seeded hashes. A row's shard is the one of the highest hash of (doc_id, shard), so
that with one shard more rows move only into it; within its shard, a second hash picks one of as many buckets as bring
a bucket to about BUCKET_BYTES and BUCKET_ROWS. Pass 2 puts a bucket's rows in sorted order, shuffles them by
Fisher-Yates (inside out: row i goes to a place j up to i, and the row there to the end, where j is a hash of the seed,
shard, bucket and i), and writes it. A shard is its buckets one after another. The order follows from rows and seed
alone, however many partitions or attempts there are; only rows equal in doc_id and text may change places with each
other, and slots are read from the written files, so that a lost executor can't give a row two of them.

Cases: a null text has no bytes, and a size of 1; a null doc_id is a key of its own. doc_id may be of any type that can
be sorted. Rows that repeat a doc_id share its shard; with equal text, too, they share a bucket. Texts of any length
are one row. An empty table gives empty shards. All columns of the input are written, whatever their names; those added
follow them and are led by an underscore, or more where the input has such a name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.text import held
from kindred.llm.samples import free_names
from kindred.plans.storage import Scratch

#: Fisher-Yates over arrays that can't be changed in place takes time with the square of a bucket's rows.
BUCKET_BYTES, BUCKET_ROWS = 8 << 20, 2048
#: Buckets whose first slots are broadcast (20 bytes each); with more, rows are joined by bucket.
FEW_BUCKETS = 200_000


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard that the key and the number of shards decide."""
    return F.array_max(F.array(*(F.struct(F.xxhash64(key, F.lit(s), F.lit(seed)).alias("h"), F.lit(s).alias("s")) for s in range(shards))))["s"]


def _fisher_yates(n: Column, *seed: Column) -> Column:
    """A permutation of 0 to n - 1."""

    def step(places: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(*seed, i), i + 1).cast("int")
        swapped = F.concat(F.slice(places, F.lit(1), j), F.array(i), F.slice(places, j + 2, i - j - 1), F.array(F.get(places, j)))
        return F.when(j == i, F.concat(places, F.array(i))).otherwise(swapped)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.array().cast("array<int>"), step)


def write_shards(docs: DataFrame, shards: int = 16, seed: int = 42) -> DataFrame:
    """Writes docs into shards in the shared folder and returns their table with _shard, _bucket and _slot."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    n = len(docs.columns)
    plain = docs.toDF(*(f"c{i}" for i in range(n)))
    wide = [F.octet_length(f.name) for f in plain.schema if f.dataType.typeName() in ("string", "binary")]
    total = plain.agg(F.count("*").alias("rows"), *(F.sum(w).alias(f"w{i}") for i, w in enumerate(wide))).first()
    size = sum(x or 0 for x in total[1:])
    buckets = max(1, -(-size // (shards * BUCKET_BYTES)), -(-total.rows // (shards * BUCKET_ROWS)))
    key, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    dealt = plain.withColumns({"_shard": shard_of(key, shards, seed), "_bucket": F.pmod(F.xxhash64(key, text, F.lit(seed + 1)), F.lit(buckets)).cast("int")})
    gathered = dealt.groupBy("_shard", "_bucket").agg(F.collect_list(F.struct(F.struct(key, F.xxhash64(text)).alias("k"), F.struct(*plain.columns).alias("row"))).alias("rows"))
    # rows and places are computed once a bucket, not for each element that the lambda takes from them
    ordered = held(gathered, "sorted", F.array_sort("rows", lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)))
    placed = ordered.select("_shard", "_bucket", "sorted", _fisher_yates(F.size("sorted"), F.lit(seed + 2), F.col("_shard"), F.col("_bucket")).alias("places"))
    shuffled = placed.select("_shard", "_bucket", F.posexplode(F.transform("places", lambda i: F.get("sorted", i)["row"])).alias("_at", "row"))
    made = shuffled.select(*(F.col(f"row.{c}").alias(c) for c in plain.columns), "_shard", "_bucket", "_at")
    at = scratch.path("files")
    made.write.partitionBy("_shard").parquet(at)
    files = spark.read.schema(made.schema).parquet(at)
    counts = files.groupBy("_shard", "_bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_shard", "_bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_start"))
    few = shards * buckets <= FEW_BUCKETS
    out = files.join(F.broadcast(starts) if few else starts, ["_shard", "_bucket"]).withColumn("_slot", (F.col("_start") + F.col("_at")).cast("long"))
    return out.select(*plain.columns, "_shard", "_bucket", "_slot").toDF(*docs.columns, *free_names(docs.columns, ["_shard", "_bucket", "_slot"]))


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    shards, seed = 16, 42
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = write_shards(docs, shards, seed)
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
        shard_of(F.col("doc_id"), shards + 1, seed).alias("grown_shard"),
    )
