"""Helpers shared by the corpus operators: shared storage, text normalisation, words."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every operator: blank, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = r"[ \t-\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A table is broadcast only when it has been counted and has at most this many (narrow) rows.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own on a local master where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to a new table in the shared folder and read it back: lineage ends there and a lost executor
    costs a re-read only."""
    path = f"{shared_dir(df.sparkSession)}/plumbline/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete tables that materialize made, once whatever was made of them has been written."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if "/plumbline/" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        drop_finished(tables[0].sparkSession)


def drop_finished(spark: SparkSession) -> None:
    """Shuffle files of finished plans go when the driver's JVM collects its garbage: ask for it, as a driver with a large
    heap may not do so for long."""
    gc.collect()
    spark._jvm.System.gc()


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast when the counted rows are within BROADCAST_ROWS; else leave the join to a shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case, nothing else changed. Plain ASCII takes the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Maximal runs of characters other than the six separators; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def row_hash(doc_id: Column, text: Column) -> Column:
    """Tells rows apart by doc_id (long) and text; rows that repeat are alike."""
    return F.xxhash64(doc_id, F.coalesce(text, F.lit("")), text.isNull())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
