"""The read layer: runs written as artefacts, decisions as flat rows with JSON columns, and the tables that pages show."""

from __future__ import annotations

import dataclasses
import json
import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators import metrics
from plumbline.operators.backtest import Book
from plumbline.operators.signals import Config
from plumbline.sources.snapshot import content_hash

ARTIFACTS = ("nav", "weights", "trades")
#: Tables that a run may have beside them.
FURTHER = ("decisions", "comparison", "model_details")


def _map(value: Column) -> Column:
    """A JSON object of a group's tickers in order; values are texts already."""
    entries = F.sort_array(F.collect_list(F.struct("ticker", F.concat(F.lit('"'), "ticker", F.lit('": '), value).alias("x"))))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: e["x"]), ", "), F.lit("}"))


def _number(c: str) -> Column:
    return F.format_string("%.6f", F.round(F.col(c), 6) + F.lit(0.0))


def flat_decisions(rows: DataFrame) -> DataFrame:
    """A row a decision from rows (strategy_id, decision_idx, exec_idx, ticker, rank, score, passes, weight); a decision
    has as many tickers as are held."""
    ranked = F.transform(F.sort_array(F.collect_list(F.struct("rank", "ticker"))), lambda x: F.concat(F.lit('"'), x["ticker"], F.lit('"')))
    return rows.groupBy("strategy_id", "decision_idx", "exec_idx").agg(
        F.lit("selection").alias("event"), F.concat(F.lit("["), F.array_join(ranked, ", "), F.lit("]")).alias("selected"), _map(_number("score")).alias("momentum_scores"),
        _map(F.col("passes").cast("string")).alias("absmom"), _map(_number("weight")).alias("w_risky"),
    )


def parsed_decisions(flat: DataFrame) -> DataFrame:
    """(strategy_id, decision_idx, exec_idx, ticker, weight, passes) from the JSON columns; a ticker without a verdict has
    not passed."""
    weights = F.from_json("w_risky", "map<string,double>")
    passed = F.coalesce(F.from_json("absmom", "map<string,boolean>")[F.col("ticker")], F.lit(False))
    rows = flat.select("strategy_id", "decision_idx", "exec_idx", "absmom", F.explode(weights).alias("ticker", "weight"))
    return rows.select("strategy_id", "decision_idx", "exec_idx", "ticker", "weight", passed.alias("passes"))


def cash_fraction(flat: DataFrame) -> DataFrame:
    """(strategy_id, decision_idx, exec_idx, cash): weight of the tickers that failed absolute momentum."""
    held = F.from_json("w_risky", "map<string,double>")
    passed = F.from_json("absmom", "map<string,boolean>")
    rows = flat.withColumn("held", held).withColumn("passed", passed)
    failed = F.map_filter("held", lambda k, _: ~F.coalesce(F.col("passed")[k], F.lit(False)))
    return rows.select("strategy_id", "decision_idx", "exec_idx", F.aggregate(F.map_values(failed), F.lit(0.0), lambda a, x: a + x).alias("cash"))


def conditional_vol(cash: DataFrame, nav: DataFrame, thresholds: list[float], target: float, tolerance: float) -> DataFrame:
    """(threshold, realized_vol, n_included, n_total, passes): days count when the selection that governs them - the last
    one executed before the day - has at most the threshold in cash. nav (idx, raw) of one strategy."""
    marks = cash.where("exec_idx is not null").select(F.col("exec_idx").alias("idx"), "cash")
    days = nav.select("idx", "raw").join(marks, "idx", "full_outer")  # trading days
    days = days.withColumn("cash", F.last("cash", True).over(Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))).where("raw is not null")
    rows = days.select("raw", "cash", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")).withColumn("in", F.col("cash") <= F.col("threshold"))
    vol = F.stddev_samp(F.when(F.col("in"), F.col("raw"))) * 252**0.5
    passes = F.coalesce(F.abs(vol - target) <= tolerance, F.lit(False))
    return rows.groupBy("threshold").agg(vol.alias("realized_vol"), F.count(F.when(F.col("in"), 1)).alias("n_included"), F.count(F.lit(1)).alias("n_total"), passes.alias("passes"))


def decision_at(flat: DataFrame, strategy: str, at: int | None) -> DataFrame:
    """The one decision of a strategy at a day, or its last; none gives no row, two are an error."""
    mine = flat.where(F.col("strategy_id") == strategy)
    day = mine.agg(F.max("decision_idx").alias("day")) if at is None else mine.agg(F.lit(at).alias("day"))
    found = mine.join(F.broadcast(day), F.col("decision_idx") == F.col("day")).drop("day")
    n = F.count(F.lit(1)).over(Window.partitionBy("strategy_id", "decision_idx"))
    twice = F.when(n > 1, F.raise_error(F.lit("more than one decision for a strategy and day"))).otherwise(F.col("event"))
    return found.withColumn("event", twice)


def layers(one: DataFrame, eligible: DataFrame, target: DataFrame) -> DataFrame:
    """(layer, key, value): what a decision saw and did, layer by layer."""
    parts = [eligible.select(F.lit("eligible").alias("layer"), F.col("ticker").alias("key"), F.lit(1.0).alias("value"))]
    for layer, c in (("momentum", "momentum_scores"), ("weight", "w_risky")):
        parts.append(one.select(F.lit(layer).alias("layer"), F.explode(F.from_json(c, "map<string,double>")).alias("key", "value")))
    parts.append(one.select(F.lit("absolute").alias("layer"), F.explode(F.from_json("absmom", "map<string,boolean>")).alias("key", "passed")).select("layer", "key", F.col("passed").cast("double").alias("value")))
    parts.append(one.select(F.lit("selected").alias("layer"), F.posexplode(F.from_json("selected", "array<string>")).alias("at", "key")).select("layer", "key", (F.col("at") + 1.0).alias("value")))
    parts.append(target.select(F.lit("target").alias("layer"), F.col("ticker").alias("key"), F.col("weight").alias("value")))
    return reduce(DataFrame.unionByName, parts)


def nearest_before(asked: DataFrame, decisions: DataFrame) -> DataFrame:
    """(day, decision_date, previous_date): the decision on or before each day and the one before that, in one ordered
    pass over both. Both are dimensions of days."""
    chain = decisions.withColumn("previous_date", F.lag("decision_date").over(Window.orderBy("decision_date")))
    marks = chain.select(F.col("decision_date").alias("at"), F.lit(None).cast("date").alias("day"), F.struct("decision_date", "previous_date").alias("d"))
    both = marks.unionByName(asked.select(F.col("day").alias("at"), "day", F.lit(None).cast("struct<decision_date:date,previous_date:date>").alias("d")))
    w = Window.orderBy("at", F.col("day").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("d", F.last("d", True).over(w)).where("day is not null and d is not null")
    return out.select("day", "d.decision_date", "d.previous_date")


def ranking(scores: DataFrame, selected: DataFrame) -> DataFrame:
    """scores (idx, ticker, score) with place and whether it was selected."""
    place = F.row_number().over(Window.partitionBy("idx").orderBy(F.desc("score"), "ticker"))
    mark = selected.select("idx", "ticker", F.lit(True).alias("selected"))
    return scores.withColumn("place", place).join(mark, ["idx", "ticker"], "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def square(long: DataFrame, rows: str, columns: str, value: str, k: int) -> DataFrame:
    """A long table of k by k values as rows with columns c1 .. ck, in the order of their names."""
    ranked = long.withColumn("j", F.dense_rank().over(Window.partitionBy(rows).orderBy(columns)))
    out = ranked.groupBy(rows).pivot("j", list(range(1, k + 1))).agg(F.max(value))
    return out.withColumnsRenamed({str(j): f"c{j}" for j in range(1, k + 1)})


def frontier(cells: DataFrame, sigma_star: float) -> DataFrame:
    """(strategy, mode, band, turnover, tracking_error, sharpe, strategy_id) of the cells labelled
    <mode>:risk.exposure_band=<band>; a label may have its strategy and a slash before it, else strategy is null."""
    label, of = F.substring_index("strategy_id", "/", -1), F.when(F.col("strategy_id").contains("/"), F.substring_index("strategy_id", "/", 1))
    rows = cells.where(label.contains(":risk.exposure_band="))
    band = F.substring_index(label, "=", -1).cast("double")
    return rows.select(of.alias("strategy"), F.substring_index(label, ":", 1).alias("mode"), band.alias("band"), "turnover", F.abs(F.col("ann_vol") - sigma_star).alias("tracking_error"), "sharpe", "strategy_id")


def price_trades(panel: DataFrame, book: Book, strategy: str, ticker: str) -> DataFrame:
    """(idx, price, weight, side, delta_weight): a ticker's price with what the strategy held and traded."""
    price = panel.where(F.col("ticker") == ticker).select("idx", F.col("p").alias("price"))
    of = (F.col("strategy_id") == strategy) & (F.col("ticker") == ticker)
    held = book.weights.where(of).select("idx", "weight")
    trades = book.trades.where(of).select(F.col("exec_idx").alias("idx"), "side", "delta_weight")
    return price.join(held, "idx", "left").join(trades, "idx", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def page(trades: DataFrame, number: int, size: int = 50) -> DataFrame:
    """A page of the blotter, newest first; pages count from 1."""
    return trades.orderBy(F.desc("exec_idx"), "ticker").offset((number - 1) * size).limit(size)


def heatmap(weights: DataFrame) -> DataFrame:
    """(idx, ticker, weight, place): every day and ticker of one strategy's weights, 0 where it is not held; places from 1 by
    mean weight over all days, the largest first, ties by ticker."""
    days = weights.select("idx").distinct()
    mean = F.sum("weight") / F.max("n")  # tickers of a menu
    order = weights.join(F.broadcast(days.agg(F.count(F.lit(1)).alias("n")))).groupBy("ticker").agg(F.round(mean, 9).alias("mean"))
    order = order.select("ticker", F.row_number().over(Window.orderBy(F.desc("mean"), "ticker")).alias("place"))
    grid = days.crossJoin(F.broadcast(order))  # trading days by tickers
    return grid.join(weights.select("idx", "ticker", "weight"), ["idx", "ticker"], "left").select("idx", "ticker", F.coalesce("weight", F.lit(0.0)).alias("weight"), "place")


#: What the overview shows of a strategy.
SHOWN = ("cagr", "ann_vol", "sharpe", "sortino", "max_drawdown", "calmar", "turnover", "average_exposure")


def overview(nav: DataFrame, weights: DataFrame, rf: DataFrame, spans: DataFrame, shown: list[str]) -> DataFrame:
    """(part, strategy_id, period, n_days, SHOWN): metrics of the strategies shown, and of the first one by period; spans
    (idx, period). A strategy without a net asset value has no row, and neither has a period without days."""
    of = lambda df: df.where(F.col("strategy_id").isin(shown))
    whole = metrics.bundle(of(nav), rf, of(weights)).select(F.lit("metrics").alias("part"), "strategy_id", F.lit("all").alias("period"), "n_days", *SHOWN)
    first = lambda df: df.where(F.col("strategy_id") == shown[0]).join(spans, "idx")
    parts = metrics.bundle(first(nav), rf, first(weights), ["strategy_id", "period"])
    return whole.unionByName(parts.select(F.lit("subperiod").alias("part"), "strategy_id", "period", "n_days", *SHOWN))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; each file starts with the byte order mark of UTF-8, by which spreadsheets know the encoding."""
    df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0]).write.option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def write_run(book: Book, folder: str, cfg: Config, **more: DataFrame) -> None:
    """A run's tables by strategy and its settings; an existing run is an error. more: further tables with a strategy_id
    (FURTHER). The manifest, one line a table with its rows and their hash, is written last: a run without it was torn."""
    if odd := sorted(set(more) - set(FURTHER)):
        raise ValueError(f"unknown artefacts: {', '.join(odd)}")
    spark, tables = book.nav.sparkSession, {name: getattr(book, name) for name in ARTIFACTS} | more
    lines = []
    for name, df in tables.items():
        df.write.mode("errorifexists").partitionBy("strategy_id").parquet(f"{folder}/{name}")
        written = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
        lines.append(content_hash(written).select(F.lit(name).alias("artifact"), "n_rows", "content"))
    settings = json.dumps(dataclasses.asdict(cfg), sort_keys=True)
    spark.createDataFrame([(settings,)], "settings string").coalesce(1).write.text(f"{folder}/config")
    reduce(DataFrame.unionByName, lines).coalesce(1).write.json(f"{folder}/manifest")


def _unescaped(c: Column) -> Column:
    """Percent escapes undone; a plus is a plus."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def _of_path(path: Column, root: str, part: int) -> Column:
    """A part of a file's path below root, counted from 0."""
    below = re.sub("^[A-Za-z0-9]+:/*", "/", root.rstrip("/")) + "/"
    return F.get(F.split(F.substr(path, F.locate(below, path) + len(below)), "/"), part)


def found_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """(run, artifact, strategy_id, n_rows) of the tables of every run below root. Counts come from footers, runs and strategies
    from the files' paths, so no run is named and no column read."""
    parts, path = [], _unescaped(F.col("_metadata.file_path"))
    for name in (*ARTIFACTS, *FURTHER):
        try:
            files = spark.read.schema("none int").option("recursiveFileLookup", True).parquet(f"{root}/*/{name}")
        except AnalysisException:  # no run has it
            continue
        rows = files.select(_of_path(path, root, 0).alias("run"), _of_path(path, root, 2).alias("strategy_id"))
        strategy = _unescaped(F.substring_index("strategy_id", "=", -1))
        parts.append(rows.groupBy("run", "strategy_id").agg(F.count(F.lit(1)).alias("n_rows")).select("run", F.lit(name).alias("artifact"), strategy.alias("strategy_id"), "n_rows"))
    if not parts:
        return spark.createDataFrame([], "run string, artifact string, strategy_id string, n_rows long")
    return reduce(DataFrame.unionByName, parts)


def runs(spark: SparkSession, root: str) -> DataFrame:
    """(run, n_files, bytes, modified, complete, reason, newest) of every run below root. A run is complete when it has its
    manifest and its tables have the rows named there; newest marks the complete one modified last, of several the last by
    name. No run gives no row."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    except AnalysisException:
        files = None
    kinds = "run string, n_files long, bytes long, modified timestamp, complete boolean, reason string, newest boolean"
    if files is None:
        return spark.createDataFrame([], kinds)
    seen = files.select(_of_path(F.col("path"), root, 0).alias("run"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("at"))
    out = seen.groupBy("run").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"), F.max("at").alias("modified"))
    try:
        lines = spark.read.schema("artifact string, n_rows long, content string").json(f"{root}/*/manifest")
        told = lines.select(_of_path(_unescaped(F.col("_metadata.file_path")), root, 0).alias("run"), "artifact", F.col("n_rows").alias("told"))
    except AnalysisException:
        told = spark.createDataFrame([], "run string, artifact string, told long")
    have = found_artifacts(spark, root).groupBy("run", "artifact").agg(F.sum("n_rows").alias("have"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    checked = told.join(have, ["run", "artifact"], "full_outer").groupBy("run").agg(
        F.count("told").alias("lines"), F.array_sort(F.collect_list(F.when(zero("told") != zero("have"), F.col("artifact")))).alias("off")  # a name an artefact
    )
    out = out.join(checked, "run", "left")
    reason = F.when(zero("lines") == 0, "no manifest").when(F.size("off") > 0, F.concat(F.lit("rows differ: "), F.array_join("off", ", ")))
    out = out.withColumn("reason", reason).withColumn("complete", F.col("reason").isNull())
    last = F.row_number().over(Window.orderBy(F.desc("complete"), F.desc("modified"), F.desc("run")))  # a row a run
    return out.withColumn("newest", F.col("complete") & (last == 1)).select("run", "n_files", "bytes", "modified", "complete", "reason", "newest")


def newest_run(spark: SparkSession, root: str) -> str:
    """The folder of the newest complete run below root; an error where there is none."""
    found = runs(spark, root).where("newest").select("run").first()
    if found is None:
        raise ValueError(f"no complete run in {root}")
    return f"{root}/{found['run']}"


def load(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A run's table, or None where the run lacks it."""
    try:
        return spark.read.parquet(f"{folder}/{name}")
    except AnalysisException:
        return None


def catalogue(spark: SparkSession, root: str, runs: list[str]) -> DataFrame:
    """(run, artifact, strategy_id, n_rows) of every table that the runs have."""
    parts = []
    for run in runs:
        for name in ARTIFACTS:
            if (df := load(spark, f"{root}/{run}", name)) is not None:
                parts.append(df.groupBy("strategy_id").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(run).alias("run"), F.lit(name).alias("artifact"), "strategy_id", "n_rows"))
    if not parts:
        return spark.createDataFrame([], "run string, artifact string, strategy_id string, n_rows long")
    return reduce(DataFrame.unionByName, parts)


def parameter_track(fits: DataFrame) -> DataFrame:
    """fits (ticker, idx, parameters, fell_back) that succeeded, with persistence and the ticker's share of fallbacks."""
    rate = F.avg(F.col("fell_back").cast("double")).over(Window.partitionBy("ticker"))
    rows = fits.withColumn("fallback_rate", rate).where("omega is not null")
    return rows.withColumn("persistence", F.col("alpha") + F.col("beta") + F.col("gamma") / 2)
