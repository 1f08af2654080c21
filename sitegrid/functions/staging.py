"""Tables written to the folder that all executors share, to cut lineage in loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local master may fall back to a temporary folder."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(place)
    return place


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` computed once: written as Parquet and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sitegrid/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, label: str) -> DataFrame:
    """``staged``, and joined by dealing out both sides. Its size as a file says little of that of its rows where these
    repeat each other, so it must not choose a broadcast."""
    return staged(df, label).hint("merge")


class Grown:
    """A table that a loop adds parts to: each part is written once, and all are read as one."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path, self.parts, self.schema = spark, f"{shared_dir(spark)}/sitegrid/{label}-{uuid.uuid4().hex}", 0, None

    def add(self, df: DataFrame) -> DataFrame:
        """The part, read back."""
        path, self.schema, self.parts = f"{self.path}/part={self.parts}", df.schema, self.parts + 1
        df.write.parquet(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).select(*self.schema.names)


class Bucketed:
    """A table that a loop adds rows to, dealt out by ``keys`` once and for all: joins and sums by these
    keys read it where it lies. Its files are in the shared folder, its name in the session's
    catalogue until ``close``."""

    def __init__(self, spark: SparkSession, label: str, keys: list[str]):
        self.spark, self.keys, self.name = spark, keys, f"{label}_{uuid.uuid4().hex}"
        self.path, self.buckets = f"{shared_dir(spark)}/sitegrid/{self.name}", int(spark.conf.get("spark.sql.shuffle.partitions"))

    def add(self, df: DataFrame) -> None:
        df.write.format("parquet").bucketBy(self.buckets, *self.keys).option("path", self.path).mode("append").saveAsTable(self.name)

    def all(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")
