"""Tables that cut a plan's lineage: written once in the folder that all executors share, then read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own on a local master where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/study/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """df as a new table. partitions: for tables whose size is that of a dimension, so that they are few files."""
    path = new_path(df.sparkSession, name)
    (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
