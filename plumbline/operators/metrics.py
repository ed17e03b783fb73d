"""Performance metrics of a NAV series as one aggregation per strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAYS = 252
#: Returns over cash nearer to zero are rounding: a book wholly in cash earns the cash rate.
TINY = 1e-12


def over_cash(ret: Column, rf: Column) -> Column:
    excess = ret - rf
    return F.when(F.abs(excess) < TINY, 0.0).otherwise(excess)


def sharpe(excess: Column) -> Column:
    mean, sd = F.avg(excess), F.stddev_samp(excess)
    return F.when(F.count(excess) < 2, None).when(sd < 1e-12, F.when(F.abs(mean) < 1e-12, 0.0)).otherwise(F.try_divide(mean, sd) * DAYS**0.5)


def sortino(excess: Column) -> Column:
    down = F.stddev_samp(F.when(excess < 0, excess))
    return F.when(F.count(F.when(excess < 0, excess)) >= 2, F.try_divide(F.avg(excess), down) * DAYS**0.5)


def with_drawdown(nav: DataFrame, by: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy(*(by or ["strategy_id"])).orderBy("idx")
    peak = F.max("nav").over(w.rowsBetween(Window.unboundedPreceding, 0))
    raw = F.col("nav") / F.lag("nav").over(w) - 1
    return nav.withColumn("drawdown", F.col("nav") / peak - 1).withColumn("raw", raw).withColumn("ret", F.coalesce("raw", F.lit(0.0)))


def average_exposure(weights: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean over days with a risky holding; all-cash days do not count."""
    by = by or ["strategy_id"]
    daily = weights.where("ticker != 'CASH'").groupBy(*by, "idx").agg(F.sum("weight").alias("e"))
    return daily.groupBy(*by).agg(F.avg("e").alias("average_exposure"))


def bundle(nav: DataFrame, rf: DataFrame, weights: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or ["strategy_id"]
    rows = with_drawdown(nav, by).join(rf.select("idx", "rf"), "idx").withColumn("excess", F.col("ret") - F.col("rf"))
    n = F.count(F.lit(1))
    first, last = F.min_by("nav", "idx"), F.max_by("nav", "idx")
    cagr = F.when(n > 1, F.pow(last / first, F.lit(float(DAYS)) / (n - 1)) - 1)
    dd = F.min("drawdown")
    out = rows.groupBy(*by).agg(
        n.alias("n_days"), cagr.alias("cagr"), (F.stddev_samp("raw") * DAYS**0.5).alias("ann_vol"),
        sharpe(F.col("excess")).alias("sharpe"), sortino(F.col("excess")).alias("sortino"), dd.alias("max_drawdown"), F.when(dd < 0, cagr / F.abs(dd)).alias("calmar"),
        (F.sum("turnover") * DAYS / n).alias("turnover"), (F.sum("cost") / first / n * DAYS * 1e4).alias("cost_drag_bps"),
    )
    return out.join(average_exposure(weights, by), by, "left")
