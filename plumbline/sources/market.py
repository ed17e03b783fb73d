"""Market tables: weekly bars by brand, the cash rate, and the views that the operators take.

bars (ticker, date, close, adj_close, volume); rates (date, DTB3). Long tables only; CASH is an ordinary ticker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def week(c: str) -> Column:
    return F.to_date(F.date_trunc("week", F.col(c)))


def bars(spark: SparkSession, d: str, condition: str = "true", ticker: str = "p_brand") -> DataFrame:
    """Weekly bars: price from the mean discount and tax, rounded so that engines agree on ties."""
    items = spark.read.parquet(f"{d}/lineitem.parquet").where(condition)
    part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col(ticker).alias("ticker"))
    price = F.round(100 * (1 + F.avg("l_discount") - F.avg("l_tax")), 6)
    joined = items.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("ticker", week("l_shipdate").alias("date")).agg(price.alias("close"), price.alias("adj_close"), F.sum("l_quantity").alias("volume"))


def rates(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet")
    done = F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0))
    return orders.groupBy(week("o_orderdate").alias("date")).agg(F.round(1 + 4 * done, 6).alias("DTB3"))


def dense(b: DataFrame) -> DataFrame:
    """Every (date, ticker) from the ticker's first bar on, the price carried forward; idx numbers the trading days."""
    days = b.select("date").distinct().withColumn("idx", F.row_number().over(Window.orderBy("date")) - 1)
    grid = days.crossJoin(b.select("ticker").distinct())  # trading days by tickers: both are dimensions
    past = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.join(b.select("ticker", "date", "close"), ["ticker", "date"], "left").withColumn("p", F.last("close", True).over(past))
    return filled.where("p is not null").select("ticker", "date", "idx", "p")


def with_returns(panel: DataFrame) -> DataFrame:
    """r: simple return over existing rows; n: bars of the ticker so far."""
    w = Window.partitionBy("ticker").orderBy("date")
    return panel.withColumn("r", F.col("p") / F.lag("p").over(w) - 1).withColumn("n", F.row_number().over(w))


def cash_rate(panel: DataFrame, r: DataFrame) -> DataFrame:
    """(date, idx, rf): rates joined on the trading date, carried forward, then backward; per day, 252 days a year."""
    w = Window.orderBy("date")
    joined = panel.select("date", "idx").distinct().join(r, "date", "left")
    forward = F.last("DTB3", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    backward = F.first("DTB3", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return joined.select("date", "idx", (F.coalesce(forward, backward) / 100 / 252).alias("rf"))


def panel(spark: SparkSession, d: str) -> DataFrame:
    return with_returns(dense(bars(spark, d)))


def last_close(b: DataFrame, at: str) -> DataFrame:
    """(ticker, date, close) of every ticker's last bar up to a day; an error for a ticker that has none yet."""
    here = F.col("date") <= F.lit(at).cast("date")
    out = b.groupBy("ticker").agg(F.max(F.when(here, F.col("date"))).alias("date"), F.max_by(F.when(here, F.col("close")), F.when(here, F.col("date"))).alias("close"))
    none = F.raise_error(F.concat(F.lit("no price yet: "), "ticker"))
    return out.withColumn("close", F.when(F.col("date").isNull(), none).otherwise(F.col("close")))
