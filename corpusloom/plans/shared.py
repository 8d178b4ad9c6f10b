"""Where long plans are cut: the folder that driver and executors share. Numbers of rows in a group that no task holds whole."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a new folder on one machine (tests), and an error on a cluster, for executors would not see it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master", "local").startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing else writes there."""
    return f"{shared_root(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written there and read again; its lineage ends, and no lost executor takes it along."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Appended:
    """A table in the shared folder to which rounds append their rows; what a round has written is never written again."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.schema = spark, scratch(spark, name), None

    def add(self, rows: DataFrame, number: int) -> DataFrame:
        """The rows of round `number`, as they are read again."""
        self.schema = self.schema or rows.schema
        rows.select(*self.schema.names).write.parquet(f"{self.path}/r={number:06d}")
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/r={number:06d}")

    def read(self) -> DataFrame:
        """The rows of all rounds; there must be one."""
        return self.spark.read.schema(self.schema).parquet(self.path).select(*self.schema.names)


def numbered(rows: DataFrame, key: str, order: list[str | Column], name: str) -> DataFrame:
    """rows with a column 0, 1, … within each key. The sort is dealt by ranges, so that a key's rows may lie in many tasks; only counts of a key in a task are windowed."""
    placed = stored(rows.orderBy(key, *order).withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)), "ordered")
    parts = placed.groupBy(key, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__low"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select(F.col(key).alias("__key"), F.col("__part").alias("__of"), (before - F.col("__low")).alias("__shift"))
    out = placed.join(starts, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__of")))
    return out.withColumn(name, F.col("__at") + F.col("__shift")).drop("__at", "__part", "__key", "__of", "__shift")
