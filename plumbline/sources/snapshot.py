"""Snapshots: hard checks as a gate, content hashes, tables in canonical order, loading with an integrity check."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators import quality
from plumbline.operators.matrices import let
from plumbline.operators.signals import Config
from plumbline.sources.tables import cut


def canonical(df: DataFrame, keys: list[str]) -> DataFrame:
    """Columns by name, rows by key."""
    return df.select(*sorted(df.columns)).orderBy(*keys)


def exact(c: Column) -> Column:
    """A double's value as text, one for each bit pattern: sign, 53-bit significand, exponent of two. No value is rounded;
    both zeros are one, so are null and NaN."""
    x = F.abs(c)
    first = F.floor(F.log2(x)).cast("int")

    def parts(e: Column) -> Column:
        up = F.lit(52) - e
        half = (up / 2).cast("int")
        return F.struct((x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), up - half)).alias("m"), e.alias("e"))

    def even(z: Column) -> Column:  # the logarithm may miss by one beside a power of two
        shift = F.when(z["m"] >= 2.0**53, -1).when(z["m"] < 2.0**52, 1).otherwise(0)
        return F.concat(F.when(c < 0, "-").otherwise("+"), (z["m"] * F.pow(F.lit(2.0), shift)).cast("long").cast("string"), F.lit("p"), (z["e"] - shift).cast("string"))

    finite = let(first, lambda e: let(parts(e), even))
    return F.when(c.isNull() | F.isnan(c), "null").when(x == float("inf"), F.when(c < 0, "-inf").otherwise("+inf")).when(c == 0, "0").otherwise(finite)


def _field(name: str, kind: str) -> Column:
    """A value as text, with a tag of its kind."""
    c = F.col(name)
    if kind in ("double", "float"):
        return F.concat(F.lit("f:"), exact(c.cast("double")))
    tag = {"date": "d:", "timestamp": "d:", "timestamp_ntz": "d:", "boolean": "b:", "string": "s:"}.get(kind, "i:")
    return F.concat(F.lit(tag), F.coalesce(c.cast("string"), F.lit("null")))


def row_digest(df: DataFrame) -> Column:
    kinds = dict(df.dtypes)
    return F.sha2(F.concat_ws("|", *(F.concat(F.lit(f"{c}="), _field(c, kinds[c])) for c in sorted(df.columns))), 256)


def content_hash(df: DataFrame) -> DataFrame:
    """(n_rows, content): a hash of the rows as a set with counts. Digests are added up, so no row order is needed and
    nothing is gathered; the value is our own, not that of a byte stream."""
    piece = F.conv(F.substring(row_digest(df), 1, 15), 16, 10).cast("decimal(38,0)")
    sums = df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(piece), F.lit(0)).cast("decimal(38,0)").alias("total"))
    return sums.select("n_rows", F.sha2(F.concat_ws("|", F.col("n_rows").cast("string"), F.col("total").cast("string")), 256).alias("content"))


#: Rows, or nodes, below one node of a tree.
FANOUT = 64


def placed(df: DataFrame, keys: list[str]) -> DataFrame:
    """(at, digest, key): each row's digest and its place, from 0, in the order of its key; rows of one key by digest. Rows
    are sorted by ranges of keys, and only a count of each range passes the driver."""
    key = F.struct(*keys)
    rows = df.select(key.alias("key"), row_digest(df).alias("digest")).repartitionByRange("key", "digest").sortWithinPartitions("key", "digest")
    rows = cut(rows.select("key", "digest", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("n")), "merkle-rows")
    counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("first"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    counts = counts.select("part", "first", before.alias("before"))
    return rows.join(F.broadcast(counts), "part").select((F.col("before") + F.col("n") - F.col("first")).alias("at"), "digest", "key")


def merkle(df: DataFrame, keys: list[str], fanout: int = FANOUT) -> DataFrame:
    """(level, node, n_rows, first_key, last_key, digest): a tree of hashes over the rows in the order of their keys. Nodes of
    level 0 are hashes of `fanout` rows each, those above of as many nodes; the last level has one. Values count to the last
    bit. A table without rows has one node over nothing."""
    if fanout < 2:
        raise ValueError("a node has two children at least")
    level = placed(df, keys).select((F.col("at") / fanout).cast("long").alias("up"), "at", F.lit(1).cast("long").alias("n_rows"), F.col("key").alias("first_key"), F.col("key").alias("last_key"), "digest")
    made: list[DataFrame] = []
    while True:
        below = F.array_sort(F.collect_list(F.struct("at", "digest")))  # `fanout` of them at most
        nodes = level.groupBy(F.col("up").alias("node")).agg(
            F.sum("n_rows").alias("n_rows"), F.min_by("first_key", "at").alias("first_key"), F.max_by("last_key", "at").alias("last_key"),
            F.sha2(F.array_join(F.transform(below, lambda c: c["digest"]), ""), 256).alias("digest"),
        )
        nodes = cut(nodes.select(F.lit(len(made)).alias("level"), "node", "n_rows", "first_key", "last_key", "digest"), "merkle-nodes")
        made.append(nodes)
        n = nodes.count()
        if n == 0:
            nothing = F.sha2(F.lit(""), 256).alias("digest")
            empty = df.sparkSession.range(1).select(F.lit(0).alias("level"), F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("n_rows"), *(F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in ("first_key", "last_key")), nothing)
            return empty
        if n == 1:
            return reduce(DataFrame.unionByName, made)
        level = nodes.select((F.col("node") / fanout).cast("long").alias("up"), F.col("node").alias("at"), "n_rows", "first_key", "last_key", "digest")


def root(tree: DataFrame) -> DataFrame:
    """(n_rows, content) of a tree's top."""
    top = tree.agg(F.max("level").alias("level"))
    return tree.join(F.broadcast(top), "level").select("n_rows", F.col("digest").alias("content"))


def changed(old: DataFrame, new: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(node, old_rows, new_rows, first_key, last_key): the ranges of level 0 whose hashes differ, found from the top: only
    children of nodes that differ are compared. A row more or less moves all rows behind it, so the first range is where it
    happened; trees of different heights are compared at level 0 alone."""
    heights = [t.agg(F.max("level")).first()[0] for t in (old, new)]
    differs = None
    for level in range(heights[0], -1, -1) if heights[0] == heights[1] else [0]:
        a, b = (t.where(F.col("level") == level).drop("level") for t in (old, new))
        if differs is not None:
            a, b = (t.withColumn("up", (F.col("node") / fanout).cast("long")).join(differs, "up", "left_semi").drop("up") for t in (a, b))
        key = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c)
        found = a.alias("a").join(b.alias("b"), F.col("a.node") == F.col("b.node"), "full_outer").where(~F.col("a.digest").eqNullSafe(F.col("b.digest")))
        zero = lambda c: F.coalesce(F.col(f"{c}.n_rows"), F.lit(0))
        found = cut(found.select(key("node"), zero("a").alias("old_rows"), zero("b").alias("new_rows"), key("first_key"), key("last_key")), "merkle-changed")
        differs = found.select(F.col("node").alias("up"))
    return found


def config_hash(cfg: Config) -> str:
    return hashlib.sha256(json.dumps(dataclasses.asdict(cfg), sort_keys=True).encode()).hexdigest()


def combined_hash(parts: dict[str, str]) -> str:
    return hashlib.sha256("|".join(f"{k}={parts[k]}" for k in sorted(parts)).encode()).hexdigest()


def snapshot_id(built: str, combined: str) -> str:
    return f"{built}_{combined[:6]}"


def load_config(path: str) -> Config:
    """A JSON file of settings; unknown names, wrong kinds and values out of range are errors."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    known = {f.name: f.type for f in dataclasses.fields(Config)}
    if unknown := sorted(set(raw) - set(known)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    kinds = {"int": int, "float": (int, float), "str": str}
    for name, value in raw.items():
        if not isinstance(value, kinds[known[name]]) or isinstance(value, bool):
            raise ValueError(f"{name} must be {known[name]}, not {value!r}")
    cfg = Config(**raw)
    checks = {
        "skip below lookback": 0 <= cfg.skip < cfg.lookback, "top_k": cfg.top_k >= 1, "check below selection": 1 <= cfg.check < cfg.selection, "lam": 0 < cfg.lam < 1,
        "sigma_star": cfg.sigma_star > 0, "e_min": 0 <= cfg.e_min <= 1, "band": cfg.band >= 0, "band_mode": cfg.band_mode in ("absolute", "log"), "bps": cfg.bps >= 0, "horizon": cfg.horizon >= 1,
    }
    if failed := [name for name, ok in checks.items() if not ok]:
        raise ValueError(f"settings out of range: {', '.join(failed)}")
    return cfg


def checks(bars: DataFrame, calendar: DataFrame, dividends: DataFrame, spot: str, max_return: float, max_gap: int, tol_bps: float) -> DataFrame:
    """(check, hard, findings, passed) of every check of bars (ticker, date, close, adj_close)."""
    grid = bars.select("date").distinct().crossJoin(bars.select("ticker").distinct())  # trading days by tickers
    grid = grid.join(bars.select("ticker", "date", "close"), ["ticker", "date"], "left")
    found = {
        "total_return": (True, quality.total_return(bars.where(F.col("ticker") == spot), dividends.where(F.col("ticker") == spot), tol_bps)),
        "extreme_returns": (False, quality.extreme_returns(bars, max_return)),
        "missing_values": (True, quality.missing_runs(grid, max_gap).where("failed")),
        "calendar": (True, quality.off_calendar(bars, calendar)),
        "repeated_keys": (True, quality.repeated_keys(bars)),
    }
    rows = [df.agg(F.count(F.lit(1)).alias("findings")).select(F.lit(k).alias("check"), F.lit(hard).alias("hard"), "findings", (F.col("findings") == 0).alias("passed")) for k, (hard, df) in found.items()]
    return reduce(DataFrame.unionByName, rows)


def gate(results: DataFrame) -> None:
    """An error that names the hard checks that failed."""
    failed = [r["check"] for r in results.where("hard and not passed").select("check").collect()]  # a row a check
    if failed:
        raise ValueError(f"hard checks failed: {', '.join(sorted(failed))}")


def create(tables: dict[str, tuple[DataFrame, list[str]]], results: DataFrame, root: str, built: str, cfg: Config) -> str:
    """Writes tables (name: rows, key) and their manifest under root once the gate lets them through; the folder's name."""
    gate(results)
    hashes: dict[str, str] = {"config": config_hash(cfg)}
    spark = results.sparkSession
    for name, (df, _) in tables.items():
        hashes[name] = content_hash(df).first()["content"]
    folder = f"{root}/{snapshot_id(built, combined_hash(hashes))}"
    for name, (df, keys) in tables.items():
        canonical(df, keys).write.mode("errorifexists").parquet(f"{folder}/{name}")
    results.coalesce(1).write.parquet(f"{folder}/checks")
    spark.createDataFrame(sorted(hashes.items()), "part string, content string").coalesce(1).write.parquet(f"{folder}/manifest")
    return folder


def described(spark: SparkSession, folder: str, prices: str = "prices") -> DataFrame:
    """(section, key, value) of a snapshot: its manifest, the checks it passed, and of each ticker its first and last day and
    number of rows."""
    manifest = spark.read.parquet(f"{folder}/manifest").select(F.lit("manifest").alias("section"), F.col("part").alias("key"), F.col("content").alias("value"))
    verdict = F.concat(F.when(F.col("hard"), "hard").otherwise("soft"), F.lit(", "), F.col("findings").cast("string"), F.lit(" findings"))
    done = spark.read.parquet(f"{folder}/checks").select(F.lit("checks").alias("section"), F.col("check").alias("key"), verdict.alias("value"))
    span = F.concat_ws(" ", F.min("date").cast("string"), F.max("date").cast("string"), F.count(F.lit(1)).cast("string"))
    tickers = spark.read.parquet(f"{folder}/{prices}").groupBy(F.col("ticker").alias("key")).agg(span.alias("value"))
    return manifest.unionByName(done).unionByName(tickers.select(F.lit("tickers").alias("section"), "key", "value"))


def load(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables of a snapshot; an error where one is not what the manifest says."""
    manifest = {r["part"]: r["content"] for r in spark.read.parquet(f"{folder}/manifest").collect()}
    out = {}
    for name in names:
        df = spark.read.parquet(f"{folder}/{name}")
        if content_hash(df).first()["content"] != manifest.get(name):
            raise ValueError(f"{name}: content differs from the manifest")
        out[name] = df
    return out


def json_safe(c: Column) -> Column:
    """NaN and infinities have no JSON form: null."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
