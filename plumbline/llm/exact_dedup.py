"""Exact dedup: binary-fuse filters of an immutable snapshot screen the digests of an incoming batch.

Texts are equal when their bytes are equal after lower-casing A-Z. The snapshot is reduced to one row per digest and to
one static filter per digest shard. The batch is grouped by digest on its own first (its duplicates never meet the
snapshot one by one), then screened shard by shard: what the filter lets through joins the snapshot's exact buckets,
everything else is new. Within every digest held by more than one row the bytes are compared with those of the row that
stays; should a digest ever hold unlike texts, its rows are grouped again by the text itself.

Only digests move, except for the texts that have a twin. Groups form by partial aggregation and rows find their group
by a plain join, so a text that fills a third of the table is no task's burden.

Defined cases: null text counts as empty and all empty texts are one group; an empty table gives an empty result; rows
that repeat both doc_id and text share one verdict and count separately in group_size; a null doc_id is smaller than any
other and stays only if its whole group has none; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import fuse_filter
from plumbline.llm.common import bounded_broadcast, lower_ascii, materialize, shuffle_partitions

#: Digests of one filter, about; a shard is built by one task.
SHARD_KEYS = 200_000


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def normalised(text: Column) -> Column:
    return lower_ascii(F.coalesce(text, F.lit("")))


def _with_shard(groups: DataFrame, shards: int) -> DataFrame:
    key = F.xxhash64("digest")
    return groups.withColumn("key", key).withColumn("shard", F.pmod(key, F.lit(shards)).cast("int"))


def build_filters(groups: DataFrame, shards: int) -> DataFrame:
    """One binary-fuse filter per shard over the distinct digests of an immutable snapshot."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        seed, seg_len, seg_count, table = fuse_filter.build(pdf["key"].to_numpy().view(np.uint64))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "seed": [seed], "seg_len": [seg_len], "seg_count": [seg_count], "cells": [table]})

    keys = _with_shard(groups, shards).select("shard", "key")
    return keys.groupBy("shard").applyInPandas(build, "shard int, seed int, seg_len int, seg_count int, cells binary")


def screen(groups: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """Adds `maybe`: false only if the snapshot certainly lacks the digest."""

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = left[["digest", "keep_id", "n"]].copy()
        out["maybe"] = False
        for _, f in right.iterrows():
            out["maybe"] = fuse_filter.contains(left["key"].to_numpy().view(np.uint64), int(f.seed), int(f.seg_len), int(f.seg_count), f.cells)
        return out

    schema = "digest binary, keep_id long, n long, maybe boolean"
    return _with_shard(groups, shards).groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(probe, schema)


def _groups(meta: DataFrame) -> DataFrame:
    return meta.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))


def exact_dedup(docs: DataFrame, incoming: Column, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, digest, keep_id, group_size, kept for every row; `incoming` tells the batch from the snapshot."""
    spark = docs.sparkSession
    text = normalised(F.col("text"))
    meta = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(incoming, F.lit(True)).alias("incoming"), digest(text).alias("digest")), "dedup-digests")

    snapshot = materialize(_groups(meta.where(~F.col("incoming"))), "dedup-snapshot")
    shards = max(shuffle_partitions(spark), -(-snapshot.count() // SHARD_KEYS))
    filters = materialize(build_filters(snapshot, shards), "dedup-filters")
    batch = materialize(screen(_groups(meta.where("incoming")), filters, shards), "dedup-screened")

    maybe = batch.where("maybe").select("digest", F.col("keep_id").alias("new_id"), F.col("n").alias("n_new"))
    known = snapshot.join(maybe, "digest", "left").select("digest", F.greatest("keep_id", "new_id").alias("keep_id"), (F.col("n") + F.coalesce("n_new", F.lit(0))).alias("n"))
    new = batch.where("not maybe").unionByName(batch.where("maybe").join(snapshot, "digest", "left_anti")).drop("maybe")
    groups = materialize(known.unionByName(new), "dedup-groups")

    twins = groups.where("n > 1").select("digest", "keep_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(text).alias("digest"), text.alias("body"))
    members = rows.join(bounded_broadcast(twins, twins.count()), "digest")
    stay = members.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("body").alias("stays"))
    stay = materialize(stay, "dedup-stays")  # a table of its own, so that the join below may split a large group
    unlike = materialize(members.join(stay, "digest").where("body != stays").select("digest"), "dedup-unlike").distinct()
    n_unlike = unlike.count()

    out = meta.join(groups, "digest").select("doc_id", "digest", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))
    if n_unlike:
        bad = rows.join(bounded_broadcast(unlike, n_unlike), "digest")
        split = bad.groupBy("digest", "body").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        again = bad.join(split, ["digest", "body"]).select("doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))
        out = out.join(bounded_broadcast(unlike, n_unlike), "digest", "left_anti").select(*again.columns).unionByName(again)
    return out


def arrival_batch(doc_id: Column) -> Column:
    """A reproducible split of a table into a snapshot and a batch of about equal size; both are read in full."""
    return F.pmod(F.xxhash64(doc_id), F.lit(2)) == 1
