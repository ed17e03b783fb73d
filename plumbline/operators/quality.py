"""Data quality: returns, gaps, calendar, duplicates, back-adjustment, comparison of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_return(bars: DataFrame, price: str = "close", name: str = "ret") -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("date")
    return bars.withColumn(name, F.try_divide(F.col(price), F.lag(price).over(w)) - 1)


def extreme_returns(bars: DataFrame, threshold: float) -> DataFrame:
    return with_return(bars).where(F.abs("ret") > threshold).select("ticker", "date", "ret")


def missing_runs(grid: DataFrame, limit: int) -> DataFrame:
    """Longest run of missing prices per ticker, leading ones exempt; failed: longer than the limit, or nothing at all."""
    w = Window.partitionBy("ticker").orderBy("date")
    seen = F.count("close").over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = grid.withColumn("seen", seen).groupBy("ticker", "seen").agg(F.count(F.when(F.col("close").isNull(), 1)).alias("gap"))
    out = runs.groupBy("ticker").agg(F.max(F.when(F.col("seen") > 0, F.col("gap")).otherwise(0)).alias("longest"), F.max("seen").alias("n"))
    return out.select("ticker", "longest", ((F.col("longest") > limit) | (F.col("n") == 0)).alias("failed"))


def off_calendar(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    return bars.select("date").distinct().join(calendar, "date", "left_anti")


def repeated_keys(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ticker", "date").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def missing_tickers(primary: DataFrame, other: DataFrame) -> DataFrame:
    return primary.select("ticker").distinct().join(other.select("ticker"), "ticker", "left_anti")


def snapped(events: DataFrame, bars: DataFrame) -> DataFrame:
    """events (ticker, event_date, ...) at the first session on or after the event; events past the end are left out.
    One ordered pass over events and sessions together instead of a range join."""
    both = bars.select("ticker", F.col("date").alias("at"), F.col("date").alias("session")).unionByName(events.select("ticker", F.col("event_date").alias("at"), F.lit(None).cast("date").alias("session")).distinct())
    ahead = Window.partitionBy("ticker").orderBy(F.col("at").desc(), F.col("session").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("date", F.last("session", True).over(ahead)).where("session is null and date is not null")
    return events.join(found.select("ticker", F.col("at").alias("event_date"), "date"), ["ticker", "event_date"])


def back_adjusted(bars: DataFrame, dividends: DataFrame, splits: DataFrame) -> DataFrame:
    """adj_close: the close times the factors of all later splits and dividends. A dividend's factor uses the raw close of
    the session before; one on the first session is skipped."""
    w = Window.partitionBy("ticker").orderBy("date")
    s = snapped(splits, bars).groupBy("ticker", "date").agg(F.product("ratio").alias("ratio"))
    d = snapped(dividends, bars).groupBy("ticker", "date").agg(F.sum("dividend").alias("dividend"))
    rows = bars.join(s, ["ticker", "date"], "left").join(d, ["ticker", "date"], "left").withColumn("before", F.lag("close").over(w))
    cash = F.when(F.col("dividend").isNotNull() & F.col("before").isNotNull(), 1 - F.col("dividend") / F.col("before")).otherwise(1.0)
    factor = cash / F.coalesce("ratio", F.lit(1.0))
    later = F.product("factor").over(w.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn("factor", factor).withColumn("adjusted", F.col("close") * F.coalesce(later, F.lit(1.0))).select("ticker", "date", "close", "adjusted")


def cross_source(primary: DataFrame, validation: DataFrame, arbiter: DataFrame, bps: float) -> DataFrame:
    """(ticker, date, pos, diff, verdict) of bars whose returns differ by more than bps; the arbiter decides by majority."""
    p = with_return(primary, name="ret_p").select("ticker", "date", "ret_p")
    v = with_return(validation, name="ret_v").select("ticker", "date", "ret_v")
    a = with_return(arbiter, name="ret_a").select("ticker", "date", "ret_a")
    rows = p.join(v, ["ticker", "date"]).where("ret_p is not null and ret_v is not null").join(a, ["ticker", "date"], "left")
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("ticker").orderBy("date")) - 1).withColumn("diff", F.abs(F.col("ret_p") - F.col("ret_v")))
    t = bps / 1e4
    dp, dv = F.abs(F.col("ret_p") - F.col("ret_a")), F.abs(F.col("ret_v") - F.col("ret_a"))
    verdict = F.when(F.col("ret_a").isNull(), "unarbitrated").when((dp <= t) & (dv > t), "validation_outlier").when((dv <= t) & (dp > t), "primary_outlier").otherwise("unresolved")
    return rows.where(F.col("diff") > t).withColumn("verdict", verdict)


def clustered(report: DataFrame, window: int, max_hits: int) -> DataFrame:
    """Tickers with max_hits findings, outliers of the validation source aside, within `window` trading days."""
    w = Window.partitionBy("ticker").orderBy("pos").rangeBetween(0, window - 1)
    hits = report.where("verdict != 'validation_outlier'").withColumn("hits", F.count(F.lit(1)).over(w))
    return hits.groupBy("ticker").agg(F.max("hits").alias("most")).where(F.col("most") >= max_hits)


def total_return(bars: DataFrame, dividends: DataFrame, tol_bps: float) -> DataFrame:
    """(ticker, date, adj_ret, expected) of ex-dates on which the adjusted return is not the return of the close plus the
    dividend over the close before. bars (ticker, date, close, adj_close) of one ticker; of more it is an error."""
    w = Window.partitionBy("ticker").orderBy("date")
    one = F.count_distinct("ticker")
    paid = dividends.groupBy("ticker", F.col("event_date").alias("date")).agg(F.sum("dividend").alias("dividend"))
    rows = bars.withColumn("before", F.lag("close").over(w)).withColumn("adj_ret", F.try_divide("adj_close", F.lag("adj_close").over(w)) - 1)
    rows = rows.join(paid, ["ticker", "date"]).where("dividend != 0 and adj_ret is not null")
    tickers = bars.agg(F.when(one > 1, F.raise_error(F.lit("total_return is a check of one ticker"))).otherwise(one).alias("tickers"))
    expected = F.col("close") / F.col("before") - 1 + F.col("dividend") / F.col("before")
    rows = rows.withColumn("expected", expected).join(F.broadcast(tickers)).where("tickers = 1")
    return rows.where(F.abs(F.col("adj_ret") - F.col("expected")) > tol_bps / 1e4).select("ticker", "date", "adj_ret", "expected")


def out_of_order(rows: DataFrame, arrival: str) -> DataFrame:
    """(ticker, date, arrival) of rows (ticker, date, arrival) that come after one with the same or a later date. Rows that
    arrive together count in the order of their dates."""
    before = F.max("date").over(Window.partitionBy("ticker").orderBy(arrival, "date").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("before", before).where("date <= before").select("ticker", "date", arrival)
