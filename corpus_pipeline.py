"""The corpus pipeline: quality rules, exact dedup, n-gram Jaccard join, mixing to target weights, best-fit packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet in the shared
folder and reads them back as the next stage's docs. All stages but the last return the columns of documents, whatever they
are; the last returns one row per packed piece. A stage knows rows by their content, so a doc_id may repeat: rows alike in
doc_id and text are copies of each other. Null, empty and very long texts are as each operator defines them; an empty table
gives an empty table; columns of any name beside doc_id, text and source are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import exact_dedup, jaccard_join, mixing, packing, quality_rules
from plumbline.llm.common import bounded_broadcast, materialize, row_hash, words
from plumbline.llm.queries import vocabulary


def _keyed(docs: DataFrame, **keys: Column) -> DataFrame:
    """Rows as one struct beside their keys, so that no name of docs meets one of ours."""
    return docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), *(c.alias(k) for k, c in keys.items()))


def _without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    gone = materialize(gone.select(*keys).distinct(), "pipeline-gone")
    return rows.join(bounded_broadcast(gone, gone.count()), keys, "left_anti")


def _one_each(rows: DataFrame, key: str) -> DataFrame:
    """One row of each key; rows that share one are looked for first, as there are none as a rule."""
    twice = materialize(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key), "pipeline-twice")
    n = twice.count()
    if not n:
        return rows
    again = rows.join(bounded_broadcast(twice, n), key, "left_semi").groupBy(key).agg(F.first("row").alias("row"))
    return rows.join(bounded_broadcast(twice, n), key, "left_anti").select("row", key).unionByName(again.select("row", key))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; a null or blank text is rejected, rows that repeat share their verdict."""
    rows = _keyed(docs, text=docs["text"])
    return quality_rules.quality_filter(rows).where("kept").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the row with the largest doc_id; one of them where that row repeats."""
    found = exact_dedup.exact_dedup(docs, exact_dedup.arrival_batch(F.col("doc_id")))
    rows = _keyed(docs, doc_id=docs["doc_id"].cast("long"), digest=exact_dedup.sha256(exact_dedup.normalised(docs["text"])))
    rows = _without(rows, found.where("not kept"), ["doc_id", "digest"])
    return _one_each(rows, "digest").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingle similarity, the row with the smallest doc_id; one of them where that row repeats.
    Documents without words are linked with nothing and stay."""
    found = jaccard_join.jaccard_components(docs)
    rows = _keyed(docs, row_hash=row_hash(docs["doc_id"].cast("long"), docs["text"]))
    rows = _without(rows, found.where("not is_first"), ["row_hash"])
    return _one_each(rows, "row_hash").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it; no copy of those that it leaves out. Rows without words are taken by
    their source's certain copies or by the draw, like others, and add no words."""
    keys = {"doc_id": docs["doc_id"], "source": docs["source"], "size": F.size(words(docs["text"])).cast("long")}
    taken = mixing.mix(docs).where("copies > 0").select(*(F.col(k).alias(f"of_{k}") for k in keys), F.col("copies").cast("int").alias("copies")).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]
    out = _keyed(docs, **keys).join(taken, same[0] & same[1] & same[2])
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, copies included, packed into sequences of at most 1024 tokens; a text without tokens is its end id."""
    pieces = packing.tokenize(docs, vocabulary()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(pieces)


STAGES = [
    ("quality rules", keep_good),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Packing has no SQL form; tests/llm/test_pipeline.py holds the stages against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
