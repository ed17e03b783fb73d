"""Event clock, eligibility, momentum, selection. Weekly parameters; every view at t ends at t."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Config:
    lookback: int = 52
    skip: int = 4
    top_k: int = 5
    min_history: int = 52
    selection: int = 5
    check: int = 2
    window: int = 26
    horizon: int = 4
    lam: float = 0.94
    sigma_star: float = 0.10
    band: float = 0.10
    band_mode: str = "absolute"
    e_min: float = 0.10
    bps: float = 5.0
    market: str = "Brand#1"
    bond: str = "Brand#2"


def clock(days: DataFrame, cfg: Config, warmup: int) -> DataFrame:
    """(date, idx, offset, is_selection, is_check, exec_idx) of the active days; the last day has no execution day."""
    offset = F.col("idx") - warmup
    out = days.select("date", "idx").distinct().withColumn("exec_idx", F.lead("idx").over(Window.orderBy("date"))).where(offset >= 0)
    return out.select("date", "idx", offset.alias("offset"), (offset % cfg.selection == 0).alias("is_selection"), (offset % cfg.check == 0).alias("is_check"), "exec_idx")


def eligible(panel: DataFrame, cfg: Config) -> DataFrame:
    return panel.where(F.col("n") >= cfg.min_history).select("date", "idx", "ticker", "n")


def momentum(panel: DataFrame, cfg: Config) -> DataFrame:
    """Cross-sectional momentum: price `skip` bars ago over price `lookback` bars ago."""
    w = Window.partitionBy("ticker").orderBy("date")
    score = F.lag("p", cfg.skip).over(w) / F.lag("p", cfg.lookback).over(w) - 1
    return panel.withColumn("score", score)


def absolute_momentum(panel: DataFrame, rf: DataFrame, cfg: Config) -> DataFrame:
    """passes: the return over the lookback beats the compounded cash rate of the last lookback days."""
    cash = F.exp(F.sum(F.log1p("rf")).over(Window.orderBy("date").rowsBetween(1 - cfg.lookback, 0))) - 1
    days = rf.select("date", cash.alias("hurdle"))
    total = F.col("p") / F.lag("p", cfg.lookback).over(Window.partitionBy("ticker").orderBy("date")) - 1
    return panel.withColumn("total", total).join(days, "date").withColumn("passes", F.col("total") > F.col("hurdle"))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("date").orderBy(F.desc("score"), "ticker")
    return scores.where("score is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def selection(panel: DataFrame, rf: DataFrame, cfg: Config, warmup: int) -> DataFrame:
    """(date, idx, exec_idx, ticker, score, rank, passes) on selection days."""
    days = clock(panel, cfg, warmup).where("is_selection").select("idx", "exec_idx")
    scored = absolute_momentum(momentum(panel, cfg), rf, cfg).where(F.col("n") >= cfg.min_history)
    return top_k(scored.join(days, "idx"), cfg.top_k).select("date", "idx", "exec_idx", "ticker", "score", "rank", "passes")
