"""Tables written in the shared folder, which cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; where that is unset, a temporary one if the master is local.

    On a cluster each executor would write to its own disk, so an unset folder is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kindred-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables of one run, under one folder; drop() removes a table that no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and returns the table read back with df's schema."""
        df.write.parquet(at := self.path(name))
        out = self.spark.read.schema(df.schema).parquet(at)
        out._kindred_path = at
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            jvm, at = self.spark._jvm, t._kindred_path
            p = jvm.org.apache.hadoop.fs.Path(at)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
