"""Backtest in closed form: between executions a book is buy-and-hold, so each segment is a product of returns and the
net asset value a product over segments. No loop over days.

targets (strategy_id, exec_idx, ticker, weight), CASH included. Order within a day: return, drift, execution with costs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.tables import cut

CASH = "CASH"


@dataclass(frozen=True)
class Book:
    nav: DataFrame
    weights: DataFrame
    trades: DataFrame


def overlapping(targets: DataFrame) -> DataFrame:
    """(strategy_id, exec_idx) for which more than one decision is outstanding: a ticker has two targets."""
    return targets.groupBy("strategy_id", "exec_idx", "ticker").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("strategy_id", "exec_idx").distinct()


def run(targets: DataFrame, panel: DataFrame, rf: DataFrame, first_idx: int, last_idx: int, bps: float) -> Book:
    """nav (strategy_id, idx, nav, turnover, cost), weights (strategy_id, idx, ticker, weight), trades per execution."""
    targets = targets.where(F.col("exec_idx").isNotNull() & (F.col("exec_idx") <= last_idx))
    if not overlapping(targets).isEmpty():
        raise ValueError("a strategy has two decisions for one execution day")
    start = targets.select("strategy_id").distinct().select("strategy_id", F.lit(first_idx - 1).alias("exec_idx"), F.lit(CASH).alias("ticker"), F.lit(1.0).alias("weight"))
    targets = start.unionByName(targets.select(*start.columns))
    segments = targets.select("strategy_id", "exec_idx").distinct()
    order = Window.partitionBy("strategy_id").orderBy("exec_idx")
    segments = segments.withColumn("next_idx", F.lead("exec_idx").over(order))
    days = segments.withColumn("idx", F.explode(F.sequence(F.col("exec_idx") + 1, F.coalesce("next_idx", F.lit(last_idx)))))

    growth = panel.select("ticker", "idx", "r").unionByName(rf.select(F.lit(CASH).alias("ticker"), "idx", F.col("rf").alias("r")))
    held = days.join(targets, ["strategy_id", "exec_idx"]).join(growth, ["ticker", "idx"], "left")
    r = F.when((F.col("weight") != 0) & F.col("r").isNull(), F.raise_error(F.lit("a held asset has no return"))).otherwise(F.coalesce("r", F.lit(0.0)))
    seg = Window.partitionBy("strategy_id", "exec_idx", "ticker").orderBy("idx")
    held = held.withColumn("value", F.col("weight") * F.product(1 + r).over(seg.rowsBetween(Window.unboundedPreceding, 0)))
    total = F.sum("value").over(Window.partitionBy("strategy_id", "idx"))
    held = held.select("strategy_id", "exec_idx", "next_idx", "idx", "ticker", "value", total.alias("total"), (F.col("value") / total).alias("drifted"))

    held = cut(held, "held")  # read by trades, NAV and weights
    before = held.where("idx = next_idx").select("strategy_id", F.col("next_idx").alias("exec_idx"), "ticker", "drifted")
    trades = before.join(targets.where(F.col("exec_idx") >= first_idx), ["strategy_id", "exec_idx", "ticker"], "full_outer")
    trades = trades.select("strategy_id", "exec_idx", "ticker", F.coalesce("drifted", F.lit(0.0)).alias("drifted_weight"), F.coalesce("weight", F.lit(0.0)).alias("target_weight"))
    trades = trades.withColumn("delta_weight", F.col("target_weight") - F.col("drifted_weight"))
    trades = cut(trades, "trades")
    turnover = trades.where(F.col("ticker") != CASH).groupBy("strategy_id", "exec_idx").agg(F.sum(F.abs("delta_weight")).alias("turnover"))

    daily = held.select("strategy_id", "exec_idx", "next_idx", "idx", "total").distinct()
    daily = daily.join(turnover.withColumnRenamed("exec_idx", "idx"), ["strategy_id", "idx"], "left").withColumn("turnover", F.coalesce("turnover", F.lit(0.0)))
    daily = daily.withColumn("gross", F.col("total")).withColumn("kept", 1 - F.col("turnover") * bps / 1e4)
    closed = daily.where("idx = next_idx").select("strategy_id", "exec_idx", (F.col("gross") * F.col("kept")).alias("factor"))
    carried = segments.join(closed, ["strategy_id", "exec_idx"], "left")
    carried = carried.select("strategy_id", "exec_idx", F.coalesce(F.product("factor").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0)).alias("carried"))
    nav = daily.join(carried, ["strategy_id", "exec_idx"])
    pre = F.col("carried") * F.col("gross")
    nav = cut(nav.select("strategy_id", "idx", (pre * F.col("kept")).alias("nav"), "turnover", (pre * (1 - F.col("kept"))).alias("cost")), "nav")

    drifting = held.where("next_idx is null or idx < next_idx").select("strategy_id", "idx", "ticker", F.col("drifted").alias("weight"))
    fresh = targets.where(F.col("exec_idx") >= first_idx).select("strategy_id", F.col("exec_idx").alias("idx"), "ticker", "weight")
    weights = drifting.unionByName(fresh)

    price = panel.select("ticker", F.col("idx").alias("exec_idx"), F.col("p").alias("fill_price"))
    value = nav.select("strategy_id", F.col("idx").alias("exec_idx"), (F.col("nav") + F.col("cost")).alias("nav_before"))
    blotter = trades.where((F.col("ticker") != CASH) & (F.abs("delta_weight") > 1e-12)).join(price, ["ticker", "exec_idx"], "left").join(value, ["strategy_id", "exec_idx"])
    notional = F.abs("delta_weight") * F.col("nav_before")
    blotter = blotter.select(
        "strategy_id", "exec_idx", "ticker", "drifted_weight", "target_weight", "delta_weight", F.when(F.col("delta_weight") > 0, "BUY").otherwise("SELL").alias("side"),
        notional.alias("notional"), "fill_price", (notional / F.col("fill_price")).alias("shares"), (notional * bps / 1e4).alias("cost"),
    )
    return Book(nav, weights, blotter)
