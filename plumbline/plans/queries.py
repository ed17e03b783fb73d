"""Registered queries of the engine, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators import backtest, correlation, metrics, portfolio, quality, signals, stats, volatility
from plumbline.plans import oracle, readers
from plumbline.plans.oracle import METRICS, book_sql, sql
from plumbline.plans.strategies import Study
from plumbline.sources import market
from plumbline.sources.tables import cut

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
C = oracle.C


def r6(c: str | Column, name: str | None = None) -> Column:
    """Rounded for comparison, without a negative zero."""
    return (F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)).alias(name or c)


def s6(expression: str, name: str | None = None) -> str:
    return f"round({expression}, 6) + 0.0 AS {name or expression}"


def query(name: str, text: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return add


@query("bars", sql("SELECT ticker, date, close, close AS adj_close, volume FROM bars", ["bars"]))
def _(spark, d):
    return market.bars(spark, d)


@query("bars_dense", sql(f"SELECT ticker, date, idx, p, {s6('r')}, n FROM panel", ["panel"]))
def _(spark, d):
    return market.panel(spark, d).select("ticker", "date", "idx", "p", r6("r"), "n")


@query("cash_rate", sql("SELECT date, idx, round(rf, 10) AS rf FROM rf", ["rf"]))
def _(spark, d):
    return market.cash_rate(market.panel(spark, d), market.rates(spark, d)).select("date", "idx", F.round("rf", 10).alias("rf"))


@query("snapshot_summary", sql("SELECT count(*) AS n_rows, count(DISTINCT ticker) AS n_tickers, min(date) AS first_date, max(date) AS last_date, string_agg(DISTINCT ticker, ',' ORDER BY ticker) AS tickers FROM bars", ["bars"]))
def _(spark, d):
    b = market.bars(spark, d)
    return b.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("ticker").alias("n_tickers"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.array_join(F.array_sort(F.collect_set("ticker")), ",").alias("tickers"))


@query("row_hashes", sql("SELECT ticker, date, sha256(ticker || '|' || date::VARCHAR || '|' || CAST(round(close * 1e6) AS BIGINT)::VARCHAR) AS digest FROM bars", ["bars"]))
def _(spark, d):
    return market.bars(spark, d).select("ticker", "date", F.sha2(F.concat_ws("|", "ticker", F.col("date").cast("string"), F.round(F.col("close") * 1e6).cast("long").cast("string")), 256).alias("digest"))


@query("clock", sql('SELECT date, idx, "offset", is_selection, is_check, exec_idx FROM clock', ["clock"]))
def _(spark, d):
    return Study(spark, d).clock


@query("eligible", sql(f"SELECT date, idx, ticker, n FROM panel WHERE n >= {C.min_history}", ["panel"]))
def _(spark, d):
    return signals.eligible(market.panel(spark, d), C)


@query("momentum", sql(f"SELECT ticker, date, {s6('score')} FROM scores WHERE score IS NOT NULL", ["scores"]))
def _(spark, d):
    return signals.momentum(market.panel(spark, d), C).where("score is not null").select("ticker", "date", r6("score"))


@query("absolute_momentum", sql(f"SELECT ticker, date, {s6('total')}, {s6('hurdle')}, passes FROM absmom WHERE total IS NOT NULL", ["absmom"]))
def _(spark, d):
    s = Study(spark, d)
    return signals.absolute_momentum(s.panel, s.rf, C).where("total is not null").select("ticker", "date", r6("total"), r6("hurdle"), "passes")


@query("selection", sql(f"SELECT date, idx, exec_idx, ticker, {s6('score')}, rank, passes FROM sel", ["sel"]))
def _(spark, d):
    return Study(spark, d).selection.select("date", "idx", "exec_idx", "ticker", r6("score"), "rank", "passes")


@query("extreme_returns", sql(f"SELECT ticker, date, {s6('ret')} FROM (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM bars) WHERE abs(ret) > 0.05", ["bars"]))
def _(spark, d):
    return quality.extreme_returns(market.bars(spark, d), 0.05).select("ticker", "date", r6("ret"))


@query("missing_runs", sql("""SELECT ticker, max(CASE WHEN seen > 0 THEN gap ELSE 0 END) AS longest, max(CASE WHEN seen > 0 THEN gap ELSE 0 END) > 1 OR max(seen) = 0 AS failed
FROM (SELECT ticker, seen, count(CASE WHEN close IS NULL THEN 1 END) AS gap FROM (SELECT *, count(close) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS seen FROM grid) GROUP BY 1, 2) GROUP BY 1""", ["grid"]))
def _(spark, d):
    b = market.bars(spark, d)
    grid = b.select("date").distinct().crossJoin(b.select("ticker").distinct()).join(b.select("ticker", "date", "close"), ["ticker", "date"], "left")
    return quality.missing_runs(grid, 1)


@query("off_calendar", sql("SELECT date FROM (SELECT DISTINCT date FROM bars) WHERE date NOT IN (SELECT date FROM rates)", ["bars", "rates"]))
def _(spark, d):
    return quality.off_calendar(market.bars(spark, d), market.rates(spark, d).select("date"))


@query("repeated_keys", "SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    raw = spark.read.parquet(f"{d}/lineitem.parquet").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("ticker"), F.to_date("l_shipdate").alias("date"))
    return quality.repeated_keys(raw)


@query("coverage_gaps", sql("SELECT DISTINCT ticker, year(date) AS year FROM bars b WHERE NOT EXISTS (SELECT 1 FROM bars_val v WHERE v.ticker = b.ticker AND year(v.date) = year(b.date))", ["bars", "bars_val"]))
def _(spark, d):
    b, v = market.bars(spark, d), market.bars(spark, d, "l_linestatus = 'O'")
    by = ["ticker", F.year("date").alias("year")]
    return b.select(*by).distinct().join(v.select(*by).distinct(), ["ticker", "year"], "left_anti")


def _dividends(b: DataFrame) -> DataFrame:
    first = b.groupBy("ticker", F.date_trunc("quarter", "date").alias("q")).agg(F.avg("close").alias("c"))
    return first.select("ticker", F.date_add(F.to_date("q"), 2).alias("event_date"), F.round(F.col("c") * 0.005, 6).alias("dividend"))


def _splits(b: DataFrame) -> DataFrame:
    return b.select("ticker", F.year("date").alias("y")).where("y = 1998").distinct().select("ticker", F.make_date("y", F.lit(6), F.lit(3)).alias("event_date"), F.lit(2.0).alias("ratio"))


_EVENTS = """div AS (SELECT ticker, CAST(q AS DATE) + 2 AS event_date, round(c * 0.005, 6) AS dividend FROM (SELECT ticker, date_trunc('quarter', date) AS q, avg(close) AS c FROM bars GROUP BY 1, 2)),
spl AS (SELECT DISTINCT ticker, DATE '1998-06-03' AS event_date, 2.0::DOUBLE AS ratio FROM bars WHERE year(date) = 1998),
ds AS (SELECT e.ticker, (SELECT min(b.date) FROM bars b WHERE b.ticker = e.ticker AND b.date >= e.event_date) AS date, dividend FROM div e),
ss AS (SELECT e.ticker, (SELECT min(b.date) FROM bars b WHERE b.ticker = e.ticker AND b.date >= e.event_date) AS date, ratio FROM spl e),
fac AS (SELECT b.ticker, b.date, b.close, lag(close) OVER (PARTITION BY b.ticker ORDER BY b.date) AS before, d.dividend, s.ratio FROM bars b
  LEFT JOIN (SELECT ticker, date, sum(dividend) AS dividend FROM ds GROUP BY 1, 2) d ON d.ticker = b.ticker AND d.date = b.date LEFT JOIN (SELECT ticker, date, product(ratio) AS ratio FROM ss GROUP BY 1, 2) s ON s.ticker = b.ticker AND s.date = b.date)"""


@query("back_adjusted", sql(f"SELECT ticker, date, close, {s6('close * coalesce(product((CASE WHEN dividend IS NOT NULL AND before IS NOT NULL THEN 1 - dividend / before ELSE 1 END) / coalesce(ratio, 1)) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1)', 'adjusted')} FROM fac", ["bars"], _EVENTS))
def _(spark, d):
    b = market.bars(spark, d)
    return quality.back_adjusted(b, _dividends(b), _splits(b)).select("ticker", "date", "close", r6("adjusted"))


@query("event_snap", sql("SELECT ticker, event_date, date FROM (SELECT e.ticker, e.event_date, (SELECT min(b.date) FROM bars b WHERE b.ticker = e.ticker AND b.date >= e.event_date) AS date FROM div e) WHERE date IS NOT NULL", ["bars"], _EVENTS))
def _(spark, d):
    b = market.bars(spark, d)
    return quality.snapped(_dividends(b), b).select("ticker", "event_date", "date")


_CROSS = """ret_of AS (SELECT 'p' AS s, ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM bars UNION ALL SELECT 'v', ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 FROM bars_val
  UNION ALL SELECT 'a', ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 FROM bars_arb),
cross0 AS (SELECT p.ticker, p.date, row_number() OVER (PARTITION BY p.ticker ORDER BY p.date) - 1 AS pos, p.ret AS ret_p, v.ret AS ret_v, a.ret AS ret_a, abs(p.ret - v.ret) AS diff
  FROM (SELECT * FROM ret_of WHERE s = 'p' AND ret IS NOT NULL) p JOIN (SELECT * FROM ret_of WHERE s = 'v' AND ret IS NOT NULL) v USING (ticker, date) LEFT JOIN (SELECT * FROM ret_of WHERE s = 'a') a USING (ticker, date)),
report AS (SELECT *, CASE WHEN ret_a IS NULL THEN 'unarbitrated' WHEN abs(ret_p - ret_a) <= 0.03 AND abs(ret_v - ret_a) > 0.03 THEN 'validation_outlier' WHEN abs(ret_v - ret_a) <= 0.03 AND abs(ret_p - ret_a) > 0.03 THEN 'primary_outlier' ELSE 'unresolved' END AS verdict FROM cross0 WHERE diff > 0.03)"""


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return quality.cross_source(market.bars(spark, d), market.bars(spark, d, "l_linestatus = 'O'"), market.bars(spark, d, "l_returnflag <> 'N'"), 300)


@query("cross_source_report", sql(f"SELECT ticker, date, pos, {s6('ret_p')}, {s6('ret_v')}, {s6('diff')}, verdict, {s6('ret_a')} FROM report", ["bars", "bars_val", "bars_arb"], _CROSS))
def _(spark, d):
    return _sources(spark, d).select("ticker", "date", "pos", r6("ret_p"), r6("ret_v"), r6("diff"), "verdict", r6("ret_a"))


@query("cross_source_clusters", sql("SELECT ticker, max(hits) AS most FROM (SELECT *, count(*) OVER (PARTITION BY ticker ORDER BY pos RANGE BETWEEN CURRENT ROW AND 29 FOLLOWING) AS hits FROM report WHERE verdict <> 'validation_outlier') GROUP BY 1 HAVING max(hits) >= 3", ["bars", "bars_val", "bars_arb"], _CROSS))
def _(spark, d):
    return quality.clustered(_sources(spark, d), 30, 3)


@query("rolling_vol", sql(f"SELECT ticker, date, {s6('vol')} FROM (SELECT ticker, date, CASE WHEN count(r) OVER w = {C.window} THEN stddev_samp(r) OVER w * sqrt(252) END AS vol FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN {C.window - 1} PRECEDING AND CURRENT ROW)) WHERE vol IS NOT NULL", ["panel"]))
def _(spark, d):
    return volatility.rolling_vol(market.panel(spark, d), C.window).where("vol is not null").select("ticker", "date", r6("vol"))


@query("ewma_vol", sql(f"SELECT ticker, date, {s6('vol')} FROM vol WHERE vol IS NOT NULL", ["vol"]))
def _(spark, d):
    return volatility.ewma(market.panel(spark, d), C.lam).where("vol is not null").select("ticker", "date", r6("vol"))


@query("ewma_residuals", sql(f"SELECT ticker, date, {s6('e')} FROM resid", ["resid"]))
def _(spark, d):
    return volatility.ewma_residuals(market.panel(spark, d), C.lam).select("ticker", "date", r6("e"))


_WALK = f"""wf AS (SELECT v.ticker, v.date, v.idx, v.variance AS forecast, f.realized FROM ewma v JOIN (SELECT ticker, k, avg(r * r) OVER w AS realized, count(*) OVER w AS c FROM ret WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {C.horizon} FOLLOWING)) f USING (ticker, k)
  WHERE v.k >= 60 AND (v.k - 60) % 5 = 0 AND f.c = {C.horizon})"""


def _walk(spark: SparkSession, d: str) -> DataFrame:
    return volatility.walk_forward(market.panel(spark, d), 60, 5, C.horizon, C.lam)


@query("vol_walk_forward", sql(f"SELECT ticker, date, {s6('forecast * 1e4', 'forecast')}, {s6('realized * 1e4', 'realized')} FROM wf", ["ewma", "ret"], _WALK))
def _(spark, d):
    return _walk(spark, d).select("ticker", "date", r6(F.col("forecast") * 1e4, "forecast"), r6(F.col("realized") * 1e4, "realized"))


@query("vol_eval", sql(f"SELECT ticker, count(*) AS n_points, {s6('avg(realized / forecast - ln(realized / forecast) - 1)', 'qlike')}, {s6('regr_r2(realized, forecast)', 'mz_r2')} FROM wf GROUP BY 1", ["ewma", "ret"], _WALK))
def _(spark, d):
    return _walk(spark, d).groupBy("ticker").agg(F.count(F.lit(1)).alias("n_points"), r6(volatility.qlike("realized", "forecast"), "qlike"), r6(F.regr_r2("realized", "forecast"), "mz_r2"))


_FIVE = f"five AS (SELECT * FROM resid WHERE ticker IN (SELECT ticker FROM sel WHERE idx = (SELECT max(idx) FROM sel)))"
_PAIRS = """pk AS (SELECT idx, row_number() OVER (ORDER BY idx) AS k, count(*) OVER () AS n FROM (SELECT idx FROM five GROUP BY idx HAVING count(*) = (SELECT count(DISTINCT ticker) FROM five))),
pr AS (SELECT pk.*, x.ticker AS ticker_i, x.e AS x, y.ticker AS ticker_j, y.e AS y FROM pk JOIN five x USING (idx) JOIN five y USING (idx))"""
_QBAR = "qb AS (SELECT ticker_i, ticker_j, 0.9 * corr(x, y) + 0.1 * (CASE WHEN ticker_i = ticker_j THEN 1 ELSE 0 END) AS q FROM pr GROUP BY 1, 2)"
_EWC = f"ss0 AS (SELECT ticker_i, ticker_j, pow({C.lam}, max(n) - 1) * covar_samp(x, y) + sum(CASE WHEN k < n THEN (1 - {C.lam}) * pow({C.lam}, n - 1 - k) * x * y END) AS s FROM pr GROUP BY 1, 2)"
_DCC = "ss0 AS (SELECT p.ticker_i, p.ticker_j, (pow(0.96, max(n) - 1) + (1 - 0.01 - 0.96) * (1 - pow(0.96, max(n) - 1)) / (1 - 0.96)) * max(q) + sum(CASE WHEN k < n THEN 0.01 * pow(0.96, n - 1 - k) * x * y END) AS s FROM pr p JOIN qb USING (ticker_i, ticker_j) GROUP BY 1, 2)"
_UNIT = "cr AS (SELECT a.ticker_i, a.ticker_j, CASE WHEN a.ticker_i = a.ticker_j THEN 1.0 ELSE a.s / sqrt(i.s * j.s) END AS corr FROM ss0 a JOIN ss0 i ON i.ticker_i = a.ticker_i AND i.ticker_j = a.ticker_i JOIN ss0 j ON j.ticker_i = a.ticker_j AND j.ticker_j = a.ticker_j)"
_BASE = ["resid", "sel"]


def _last_pairs(s: Study) -> DataFrame:
    sel = s.selection
    last = sel.agg(F.max("idx").alias("idx"))
    return correlation.pairs(s.resid.join(sel.join(last, "idx").select("ticker"), "ticker"))


@query("q_bar", sql(f"SELECT ticker_i, ticker_j, {s6('q')} FROM qb", _BASE, f"{_FIVE},{_PAIRS},{_QBAR}"))
def _(spark, d):
    return correlation.q_bar(_last_pairs(Study(spark, d)), 0.1).select("ticker_i", "ticker_j", r6("q"))


@query("ewma_corr", sql(f"SELECT ticker_i, ticker_j, {s6('corr')} FROM cr", _BASE, f"{_FIVE},{_PAIRS},{_EWC},{_UNIT}"))
def _(spark, d):
    return correlation.ewma_corr(_last_pairs(Study(spark, d)), C.lam).select("ticker_i", "ticker_j", r6("corr"))


@query("dcc_corr", sql(f"SELECT ticker_i, ticker_j, {s6('corr')} FROM cr", _BASE, f"{_FIVE},{_PAIRS},{_QBAR},{_DCC},{_UNIT}"))
def _(spark, d):
    return correlation.dcc_corr(_last_pairs(Study(spark, d)), 0.01, 0.96, 0.1).select("ticker_i", "ticker_j", r6("corr"))


@query("covariance", sql(f"SELECT ticker_i, ticker_j, {s6('a.vol * corr * b.vol', 'cov')} FROM cr JOIN vol a ON a.ticker = ticker_i AND a.idx = (SELECT max(idx) FROM vol) JOIN vol b ON b.ticker = ticker_j AND b.idx = a.idx", [*_BASE, "vol"], f"{_FIVE},{_PAIRS},{_EWC},{_UNIT}"))
def _(spark, d):
    s = Study(spark, d)
    last = s.vol.where(F.col("idx") == s.last_idx)
    return correlation.covariance(correlation.ewma_corr(_last_pairs(s), C.lam), last).select("ticker_i", "ticker_j", r6("cov"))


@query("inverse_vol", sql(f"SELECT epoch_idx AS decision_idx, ticker, {s6('weight')} FROM ivol", ["ivol"]))
def _(spark, d):
    return Study(spark, d)._risky().select("decision_idx", "ticker", r6("weight"))


@query("exposure_band", sql(f"SELECT epoch_idx, idx, {s6('sigma_p')}, {s6('exposure')}, {s6('applied')}, blocked FROM e_ivol", ["e_ivol"]))
def _(spark, d):
    s = Study(spark, d)
    return s.exposures(s._risky().withColumnRenamed("decision_idx", "epoch_idx")).select("epoch_idx", "idx", r6("sigma_p"), r6("exposure"), r6("applied"), "blocked")


SQL_STRATEGIES = ["bh_market", "ew_menu", "sixty_forty", "mom_only", "mom_ivol", "voltarget_only", "full", "full_erc", "full_garch_dcc"]


def _book_queries(name: str, text: bool) -> None:
    def targets(spark: SparkSession, d: str) -> DataFrame:
        return Study(spark, d).targets(name).select("strategy_id", "decision_idx", "exec_idx", "ticker", r6("weight"))

    def nav(spark: SparkSession, d: str) -> DataFrame:
        return Study(spark, d).book(name).nav.select("strategy_id", "idx", r6("nav"), r6("turnover"), r6("cost"))

    QUERIES[f"targets_{name}"], QUERIES[f"nav_{name}"] = targets, nav
    if text:
        SQL[f"targets_{name}"] = sql(f"SELECT strategy_id, decision_idx, exec_idx, ticker, {s6('weight')} FROM t_{name}", [f"t_{name}"])
        SQL[f"nav_{name}"] = book_sql(f"SELECT strategy_id, idx, {s6('nav')}, {s6('turnover')}, {s6('cost')} FROM nav", [name])


for _name in SQL_STRATEGIES:
    _book_queries(_name, True)
for _name in ("full_gjr", "full_garch"):
    _book_queries(_name, False)

_FOUR = ["bh_market", "ew_menu", "sixty_forty", "mom_only", "mom_ivol"]


@query("weights_mom_only", book_sql(f"SELECT strategy_id, idx, ticker, {s6('weight')} FROM wts", ["mom_only"]))
def _(spark, d):
    return Study(spark, d).book("mom_only").weights.select("strategy_id", "idx", "ticker", r6("weight"))


_BLOTTER = f"""SELECT t.strategy_id, t.exec_idx, t.ticker, {s6('target_weight - drifted_weight', 'delta_weight')}, CASE WHEN target_weight > drifted_weight THEN 'BUY' ELSE 'SELL' END AS side,
  {s6('abs(target_weight - drifted_weight) * (nav + cost)', 'notional')}, {s6('abs(target_weight - drifted_weight) * (nav + cost) / p', 'shares')} FROM trades t JOIN nav n ON n.strategy_id = t.strategy_id AND n.idx = t.exec_idx JOIN panel q ON q.ticker = t.ticker AND q.idx = t.exec_idx
  WHERE t.ticker <> 'CASH' AND abs(target_weight - drifted_weight) > 1e-12"""


@query("blotter_mom_only", book_sql(_BLOTTER, ["mom_only"]))
def _(spark, d):
    return Study(spark, d).book("mom_only").trades.select("strategy_id", "exec_idx", "ticker", r6("delta_weight"), "side", r6("notional"), r6("shares"))


_KEYS = ("cagr", "ann_vol", "sharpe", "sortino", "max_drawdown", "calmar", "turnover", "cost_drag_bps", "average_exposure")


@query("metrics_all", book_sql(f"SELECT strategy_id, n_days, {', '.join(s6(k) for k in _KEYS)} FROM (SELECT strategy_id, {METRICS} FROM dd JOIN rf USING (idx) GROUP BY 1) LEFT JOIN ex USING (strategy_id)", _FOUR))
def _(spark, d):
    s = Study(spark, d)
    b = s.book(*_FOUR)
    return metrics.bundle(b.nav, s.rf, b.weights).select("strategy_id", "n_days", *(r6(k) for k in _KEYS))


@query("drawdown", book_sql(f"SELECT strategy_id, idx, {s6('drawdown')}, {s6('raw')} FROM dd", _FOUR))
def _(spark, d):
    return metrics.with_drawdown(Study(spark, d).book(*_FOUR).nav).select("strategy_id", "idx", r6("drawdown"), r6("raw"))


def _spans(s: Study) -> DataFrame:
    return s.rf.select("idx", F.when(F.year("date") <= 1998, "a").otherwise("b").alias("period"))


_SPANS = "(VALUES ('a', 1995, 1998), ('b', 1999, 9999)) v(period, lo, hi) ON year(rf.date) BETWEEN lo AND hi"


_SUBPERIODS = f"""(SELECT strategy_id, period, {METRICS} FROM
  (SELECT d.strategy_id, d.idx, d.nav, d.turnover, d.cost, rf, period, d.nav / max(d.nav) OVER (w ROWS UNBOUNDED PRECEDING) - 1 AS drawdown, d.nav / lag(d.nav) OVER w - 1 AS raw FROM nav d JOIN rf USING (idx) JOIN {_SPANS} WINDOW w AS (PARTITION BY d.strategy_id, period ORDER BY d.idx)) GROUP BY 1, 2)
  LEFT JOIN (SELECT strategy_id, period, avg(e) AS average_exposure FROM (SELECT strategy_id, idx, sum(weight) AS e FROM wts WHERE ticker <> 'CASH' GROUP BY 1, 2) JOIN rf USING (idx) JOIN {_SPANS} GROUP BY 1, 2) USING (strategy_id, period)"""


@query("subperiod_metrics", book_sql(f"SELECT strategy_id, period, n_days, {', '.join(s6(k) for k in (*_KEYS[:6], 'average_exposure'))} FROM {_SUBPERIODS}", _FOUR))
def _(spark, d):
    s = Study(spark, d)
    b = s.book(*_FOUR)
    span = _spans(s)
    out = metrics.bundle(b.nav.join(span, "idx"), s.rf, b.weights.join(span, "idx"), ["strategy_id", "period"])
    return out.select("strategy_id", "period", "n_days", *(r6(k) for k in (*_KEYS[:6], "average_exposure")))


@query("strategy_moments", book_sql(f"SELECT strategy_id, n, {s6('m / sd', 'sr')}, {s6('m3 / pow(m2, 1.5)', 'skew')}, {s6('m4 / (m2 * m2)', 'kurt')} FROM (SELECT strategy_id, count(raw) AS n, any_value(mu) AS m, stddev_samp(raw) AS sd, avg(pow(raw - mu, 2)) AS m2, avg(pow(raw - mu, 3)) AS m3, avg(pow(raw - mu, 4)) AS m4 FROM (SELECT *, avg(raw) OVER (PARTITION BY strategy_id) AS mu FROM dd WHERE raw IS NOT NULL) GROUP BY 1)", _FOUR))
def _(spark, d):
    nav = metrics.with_drawdown(Study(spark, d).book(*_FOUR).nav).where("raw is not null").withColumn("ret", F.col("raw"))
    return stats.moments(nav).select("strategy_id", "n", r6("sr"), r6("skew"), r6("kurt"))


def _returns(s: Study, names: list[str]) -> DataFrame:
    return _returns_of(s.book(*names), s)


def _returns_of(book: backtest.Book, s: Study) -> DataFrame:
    nav = metrics.with_drawdown(book.nav).where("raw is not null")
    return nav.join(s.rf.select("idx", "rf"), "idx").select("strategy_id", "idx", F.col("raw").alias("ret"), metrics.over_cash(F.col("raw"), F.col("rf")).alias("excess"))


def _moments_sql(source: str) -> str:
    """CTE mo: per-period Sharpe ratio and moments of the returns over cash."""
    return f"""mo AS (SELECT strategy_id, count(*) AS n, any_value(mu) / stddev_samp(excess) AS sr, avg(pow(excess - mu, 3)) / pow(avg(pow(excess - mu, 2)), 1.5) AS skew, avg(pow(excess - mu, 4)) / pow(avg(pow(excess - mu, 2)), 2) AS kurt
  FROM (SELECT *, avg(excess) OVER (PARTITION BY strategy_id) AS mu FROM {source}) GROUP BY 1)"""


def _horner_sql(coefficients: tuple[float, ...], x: str) -> str:
    return reduce(lambda a, c: f"({a} * {x} + {c!r})", coefficients[1:], repr(coefficients[0]))


def _cdf_sql(x: str) -> str:
    near = f"exp(-a * a / 2) * {_horner_sql(stats.CDF_UP, 'a')} / {_horner_sql(stats.CDF_DOWN, 'a')}"
    far = f"exp(-a * a / 2) / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / {stats.ROOT_2PI!r}"
    return f"(SELECT CASE WHEN y > 0 THEN 1 - t ELSE t END FROM (SELECT y, CASE WHEN a < {stats.CDF_FAR!r} THEN {near} ELSE {far} END AS t FROM (SELECT x AS y, abs(x) AS a FROM (SELECT {x} AS x))))"


def _psr_sql(benchmark: str) -> str:
    return _cdf_sql(f"(sr - {benchmark}) * sqrt(n - 1) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr)")


@query("psr_dsr", book_sql(f"SELECT * FROM (WITH xr AS (SELECT strategy_id, raw - rf AS excess FROM dd JOIN rf USING (idx) WHERE raw IS NOT NULL), {_moments_sql('xr')} SELECT strategy_id, {s6(_psr_sql('0.0'), 'psr')}, {s6(_psr_sql(f'sqrt((SELECT var_samp(sr) FROM mo)) * {stats.max_quantile(len(_FOUR))!r}'), 'dsr')} FROM mo)", _FOUR))
def _(spark, d):
    m = stats.moments(_returns(Study(spark, d), _FOUR), "excess")
    spread = F.var_samp("sr").over(Window.partitionBy())  # one row a strategy
    m = m.withColumn("benchmark", stats.expected_max_sharpe(spread, len(_FOUR)))
    args = [F.col(c) for c in ("sr", "n", "skew", "kurt")]
    return m.select("strategy_id", r6(stats.psr(*args, F.lit(0.0)), "psr"), r6(stats.psr(*args, F.col("benchmark")), "dsr"))


PBO_BLOCKS = 16
_PBO = f"""bl AS (SELECT strategy_id, CAST(floor((idx - f) / floor(n / {PBO_BLOCKS})) AS INT) AS block, raw FROM dd, (SELECT min(idx) AS f, count(DISTINCT idx) AS n FROM dd WHERE raw IS NOT NULL) WHERE raw IS NOT NULL),
bs AS (SELECT strategy_id, block, count(*) AS n, sum(raw) AS s, sum(raw * raw) AS q FROM bl WHERE block < {PBO_BLOCKS} GROUP BY 1, 2),
cm AS (SELECT m FROM (SELECT unnest(range(0, {1 << PBO_BLOCKS})) AS m) WHERE bit_count(m) = {PBO_BLOCKS // 2}),
io AS (SELECT m, strategy_id, (m >> block) & 1 AS inside, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM cm CROSS JOIN bs GROUP BY 1, 2, 3),
pf AS (SELECT m, strategy_id, max(CASE WHEN inside = 1 THEN v END) AS train, max(CASE WHEN inside = 0 THEN v END) AS test FROM (SELECT *, s / n / sqrt(greatest((q - s * s / n) / (n - 1), 0)) AS v FROM io) GROUP BY 1, 2),
pk AS (SELECT *, rank() OVER (PARTITION BY m ORDER BY test) AS rk, count(*) OVER (PARTITION BY m) AS k, row_number() OVER (PARTITION BY m ORDER BY train DESC, strategy_id) AS pick FROM pf)"""


@query("pbo", book_sql(f"SELECT * FROM (WITH {_PBO} SELECT m AS combo, strategy_id AS best, {s6('rk / (k + 1)', 'omega')}, {s6('ln(rk / (k + 1) / (1 - rk / (k + 1)))', 'logit')} FROM pk WHERE pick = 1)", _FOUR))
def _(spark, d):
    return stats.overfitting(_returns(Study(spark, d), _FOUR), PBO_BLOCKS).select("combo", "best", r6("omega"), r6("logit"))


@query("pareto_front", book_sql(f"SELECT strategy_id, {s6('turnover')}, {s6('ann_vol')} FROM (SELECT a.* FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.strategy_id <> a.strategy_id AND b.turnover <= a.turnover AND b.ann_vol <= a.ann_vol AND (b.turnover < a.turnover OR b.ann_vol < a.ann_vol)))".replace("FROM (SELECT a.*", "FROM (WITH m AS (SELECT strategy_id, sum(turnover) * 252 / count(*) AS turnover, stddev_samp(raw) * sqrt(252) AS ann_vol FROM dd GROUP BY 1) SELECT a.*"), _FOUR))
def _(spark, d):
    s = Study(spark, d)
    b = s.book(*_FOUR)
    return stats.pareto_front(metrics.bundle(b.nav, s.rf, b.weights).select("strategy_id", "turnover", "ann_vol"), "turnover", "ann_vol").select("strategy_id", r6("turnover"), r6("ann_vol"))


@query("residual_acf", sql(f"SELECT ticker, lag, {s6('num / q', 'acf')} FROM (SELECT ticker, lag, sum(x * y) AS num FROM (SELECT a.ticker, l.lag, a.x, b.x AS y FROM ac a JOIN (SELECT unnest(range(1, 21)) AS lag) l ON TRUE JOIN ac b ON b.ticker = a.ticker AND b.k = a.k - l.lag) GROUP BY 1, 2) JOIN (SELECT ticker, sum(x * x) AS q FROM ac GROUP BY 1) USING (ticker)", ["resid"], "ac AS (SELECT ticker, k, e - avg(e) OVER (PARTITION BY ticker) AS x FROM resid)"))
def _(spark, d):
    return stats.autocorrelation(volatility.ewma_residuals(market.panel(spark, d), C.lam), "ticker", "e", 20).select("ticker", "lag", r6("acf"))


@query("holdings_heatmap", book_sql(f"SELECT idx, ticker, {s6('coalesce(weight, 0)', 'weight')}, place FROM (SELECT DISTINCT idx FROM wts) CROSS JOIN (SELECT ticker, row_number() OVER (ORDER BY round(sum(weight) / (SELECT count(DISTINCT idx) FROM wts), 9) DESC, ticker) AS place FROM wts GROUP BY 1) LEFT JOIN wts USING (idx, ticker)", ["mom_only"]))
def _(spark, d):
    w = cut(Study(spark, d).book("mom_only").weights, "weights")
    return readers.heatmap(w).select("idx", "ticker", r6("weight"), "place")


@query("turnover_cost_series", book_sql(f"SELECT strategy_id, idx, {s6('turnover')}, {s6('sum(cost) OVER (PARTITION BY strategy_id ORDER BY idx ROWS UNBOUNDED PRECEDING)', 'cumulative_cost')} FROM nav", _FOUR))
def _(spark, d):
    upto = F.sum("cost").over(Window.partitionBy("strategy_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return Study(spark, d).book(*_FOUR).nav.select("strategy_id", "idx", r6("turnover"), r6(upto, "cumulative_cost"))


@query("governing_selection", sql("SELECT r.idx, max(e.exec_idx) AS exec_idx FROM days r JOIN (SELECT DISTINCT exec_idx FROM sel WHERE exec_idx IS NOT NULL) e ON e.exec_idx < r.idx GROUP BY r.idx", ["sel", "days"]))
def _(spark, d):
    s = Study(spark, d)
    days = s.panel.select("idx").distinct().join(s.selection.select(F.col("exec_idx").alias("idx"), "exec_idx").distinct(), "idx", "left")
    return days.withColumn("exec_idx", F.last("exec_idx", True).over(Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))).where("exec_idx is not null")


@query("garch_fit")
def _(spark, d):
    s = Study(spark, d)
    last = s.panel.where(F.col("idx") == s.last_idx).select("ticker", "idx")
    return volatility.refit(s.panel, last, C.horizon)


@query("gjr_volatility")
def _(spark, d):
    s = Study(spark, d)
    return s.filtered("gjr", s.fits(True))[0].select("ticker", "idx", r6("vol"))


@query("erc_weights", sql(f"SELECT epoch_idx AS idx, ticker, {s6('weight')} FROM ercw", ["ercw"]))
def _(spark, d):
    """Equal risk contributions of the assets of every selection."""
    s = Study(spark, d)
    cov = s.covariances(s.selection.select("idx", "ticker"))
    return portfolio.erc_weights(cov, "idx").select("idx", "ticker", r6("weight"))
