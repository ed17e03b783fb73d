"""Vendors' payloads to tidy prices (date, ticker, close, adj_close, volume). Parsing only; nothing is fetched.

A payload is one text per ticker, as its vendor sends it. Empty payloads and empty lists give no rows; a vendor without
adjusted prices gives null there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import quality

PRICES = "date date, ticker string, close double, adj_close double, volume double"


def empty_prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], PRICES)


def _tidy(rows: DataFrame, date: Column, close: Column, adj_close: Column, volume: Column) -> DataFrame:
    double = [c.cast("double").alias(k) for k, c in (("close", close), ("adj_close", adj_close), ("volume", volume))]
    return rows.select(F.to_date(date).alias("date"), "ticker", *double)


def tiingo(payloads: DataFrame) -> DataFrame:
    """payloads (ticker, payload): a JSON list of days; times are UTC."""
    days = F.from_json("payload", "array<struct<date:string,close:double,adjClose:double,volume:double>>")
    rows = payloads.select("ticker", F.explode(days).alias("x"))
    return _tidy(rows, F.substring("x.date", 1, 10), F.col("x.close"), F.col("x.adjClose"), F.col("x.volume"))


def twelvedata(payloads: DataFrame) -> DataFrame:
    """payloads (ticker, payload): a JSON object with `values`, all numbers as texts."""
    kind = "struct<values:array<struct<datetime:string,close:string,volume:string>>>"
    rows = payloads.select("ticker", F.explode(F.from_json("payload", kind)["values"]).alias("x"))
    return _tidy(rows, F.col("x.datetime"), F.col("x.close"), F.lit(None), F.col("x.volume"))


def stooq(payloads: DataFrame) -> DataFrame:
    """payloads (ticker, payload): CSV with a header line Date,Open,High,Low,Close,Volume."""
    line = F.explode(F.slice(F.split("payload", r"\r?\n"), 2, 1 << 30)).alias("line")
    rows = payloads.where("payload is not null").select("ticker", line).where("trim(line) != ''")
    rows = rows.select("ticker", F.from_csv("line", "d string, o double, h double, l double, c double, v double").alias("x"))
    return _tidy(rows, F.col("x.d"), F.col("x.c"), F.lit(None), F.col("x.v"))


def fred(lines: DataFrame, series: str) -> DataFrame:
    """lines (line): CSV lines DATE,value in any order, '.' where a day has no value; (date, series) by date."""
    rows = lines.select(F.split("line", ",").alias("x")).where("x[0] != 'DATE'")
    return rows.select(F.expr("try_cast(x[0] AS date)").alias("date"), F.expr("try_cast(x[1] AS double)").alias(series)).orderBy("date")


def dividends(raw: DataFrame, start: str, end: str) -> DataFrame:
    """(ticker, event_date, dividend) of raw (ticker, at timestamp, dividend) within start and end, times cut off."""
    return raw.select("ticker", F.to_date("at").alias("event_date"), F.col("dividend").cast("double").alias("dividend")).where(F.col("event_date").between(start, end))


def yfinance(bars: DataFrame, paid: DataFrame) -> DataFrame:
    """bars (ticker, at timestamp, Close, Volume), split-adjusted already; adj_close is rebuilt from the dividends."""
    tidy = bars.select("ticker", F.to_date("at").alias("date"), F.col("Close").cast("double").alias("close"), F.col("Volume").cast("double").alias("volume"))
    none = paid.sparkSession.createDataFrame([], "ticker string, event_date date, ratio double")
    adjusted = quality.back_adjusted(tidy.select("ticker", "date", "close"), paid, none)
    return tidy.join(adjusted.select("ticker", "date", "adjusted"), ["ticker", "date"]).select("date", "ticker", "close", F.col("adjusted").alias("adj_close"), "volume")


def redacted(url: Column) -> Column:
    """Keys in a query string are hidden before a text is shown or logged."""
    return F.regexp_replace(url, r"(token|apikey)=[^&\s]+", "$1=***")
