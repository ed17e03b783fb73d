"""Queries of sources, snapshots and checks. Vendors' payloads are made by Spark from the given tables, then parsed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators import quality
from plumbline.plans.oracle import C, sql
from plumbline.plans.queries import _EVENTS, _dividends, _splits, query, r6, s6
from plumbline.sources import market, snapshot, vendors
from plumbline.sources.tables import cut, new_path


def _listed(b: DataFrame, item) -> DataFrame:
    """(ticker, payload): a JSON list of each ticker's bars, and an empty list for a ticker without any."""
    full = b.groupBy("ticker").agg(F.to_json(F.sort_array(F.collect_list(item))).alias("payload"))  # one vendor file a ticker
    return full.unionByName(b.limit(1).select(F.lit("NONE").alias("ticker"), F.lit("[]").alias("payload")))


@query("parse_tiingo", sql("SELECT ticker, date, close, close AS adj_close, volume FROM bars", ["bars"]))
def _(spark, d):
    item = F.struct(F.concat(F.col("date").cast("string"), F.lit("T00:00:00.000Z")).alias("date"), "close", F.col("adj_close").alias("adjClose"), "volume")
    return vendors.tiingo(_listed(market.bars(spark, d), item))


@query("parse_twelvedata", sql("SELECT ticker, date, close, NULL::DOUBLE AS adj_close, volume FROM bars", ["bars"]))
def _(spark, d):
    item = F.struct(F.col("date").cast("string").alias("datetime"), F.col("close").cast("string").alias("close"), F.col("volume").cast("string").alias("volume"))
    p = _listed(market.bars(spark, d), item)
    return vendors.twelvedata(p.withColumn("payload", F.concat(F.lit('{"status":"ok","values":'), "payload", F.lit("}"))))


@query("parse_stooq", sql("SELECT ticker, date, close, NULL::DOUBLE AS adj_close, volume FROM bars", ["bars"]))
def _(spark, d):
    line = F.concat_ws(",", "date", "close", "close", "close", "close", "volume")
    rows = market.bars(spark, d).groupBy("ticker").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("payload"))
    return vendors.stooq(rows.select("ticker", F.concat(F.lit("Date,Open,High,Low,Close,Volume\n"), "payload").alias("payload")))


@query("parse_fred", sql("SELECT date, CASE WHEN dayofyear(date) % 5 <> 0 THEN DTB3 END AS DTB3 FROM rates", ["rates"]))
def _(spark, d):
    r = market.rates(spark, d)
    value = F.when(F.dayofyear("date") % 5 == 0, ".").otherwise(F.col("DTB3").cast("string"))
    head = r.limit(1).select(F.lit("DATE,DTB3").alias("line"))
    return vendors.fred(head.unionByName(r.select(F.concat_ws(",", "date", value).alias("line"))), "DTB3")


@query("parse_yfinance", sql(f"""SELECT ticker, date, close, volume, {s6('close * coalesce(product(CASE WHEN dividend IS NOT NULL AND before IS NOT NULL THEN 1 - dividend / before ELSE 1 END) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1)', 'adj_close')}
FROM fac JOIN bars USING (ticker, date, close)""", ["bars"], _EVENTS))
def _(spark, d):
    b = market.bars(spark, d)
    raw = b.select("ticker", F.to_timestamp("date").alias("at"), F.col("close").alias("Close"), F.col("volume").alias("Volume"))
    return vendors.yfinance(raw, _dividends(b)).withColumn("adj_close", r6("adj_close"))


@query("dividends_clipped", sql("SELECT ticker, event_date, dividend FROM div WHERE event_date BETWEEN DATE '1995-01-01' AND DATE '1997-12-31'", ["bars"], _EVENTS))
def _(spark, d):
    raw = _dividends(market.bars(spark, d)).select("ticker", (F.to_timestamp("event_date") + F.expr("INTERVAL 9 HOURS")).alias("at"), "dividend")
    return vendors.dividends(raw, "1995-01-01", "1997-12-31")


@query("tidy_union", sql("SELECT ticker, date, close, close AS adj_close, volume FROM bars WHERE ticker < 'Brand#2' UNION ALL SELECT ticker, date, close, close, volume FROM bars_val WHERE ticker >= 'Brand#2'", ["bars", "bars_val"]))
def _(spark, d):
    parts = [market.bars(spark, d).where("ticker < 'Brand#2'"), market.bars(spark, d, "l_linestatus = 'O'").where("ticker >= 'Brand#2'")]
    return reduce(DataFrame.unionByName, (p.select("date", "ticker", "close", "adj_close", "volume") for p in parts), vendors.empty_prices(spark))


@query("redacted_urls", "SELECT event_id, 'https://host/v1?token=***&n=' || event_id AS url FROM events")
def _(spark, d):
    url = F.concat(F.lit("https://host/v1?token="), F.md5(F.col("event_id").cast("string")), F.lit("&n="), "event_id")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", vendors.redacted(url).alias("url"))


def _exact_sql(x: str) -> str:
    """A double's bits as text; values are not zero, finite and normal here, or null."""
    e = f"CAST(floor(log2(abs({x}))) AS INT)"
    m = f"(abs({x}) * pow(2.0::DOUBLE, 52 - {e}))"
    shift = f"CASE WHEN {m} >= pow(2.0::DOUBLE, 53) THEN -1 WHEN {m} < pow(2.0::DOUBLE, 52) THEN 1 ELSE 0 END"
    return f"CASE WHEN {x} IS NULL THEN 'null' WHEN {x} = 0 THEN '0' ELSE (CASE WHEN {x} < 0 THEN '-' ELSE '+' END) || CAST({m} * pow(2.0::DOUBLE, {shift}) AS BIGINT) || 'p' || ({e} - {shift}) END"


def _row_sql(kinds: dict[str, str]) -> str:
    """The digest of a row by its columns."""
    field = {"d": lambda c: f"'d:' || {c}::VARCHAR", "s": lambda c: f"'s:' || {c}", "f": lambda c: f"'f:' || {_exact_sql(f'CAST({c} AS DOUBLE)')}"}
    text = " || '|' || ".join(f"'{c}=' || {field[k](c)}" for c, k in sorted(kinds.items()))
    return f"sha256({text})"


def _content_sql(rows: str, kinds: dict[str, str]) -> str:
    return f"SELECT count(*) AS n_rows, sha256(count(*)::VARCHAR || '|' || sum(('0x' || substr({_row_sql(kinds)}, 1, 15))::BIGINT)::VARCHAR) AS content FROM {rows}"


_KINDS = {"ticker": "s", "date": "d", "close": "f", "adj_close": "f", "volume": "f"}


@query("content_hashes", sql(f"SELECT 'prices' AS part, * FROM ({_content_sql('(SELECT *, close AS adj_close FROM bars)', _KINDS)}) UNION ALL SELECT 'rates', * FROM ({_content_sql('rates', {'date': 'd', 'DTB3': 'f'})})", ["bars", "rates"]))
def _(spark, d):
    tables = {"prices": market.bars(spark, d), "rates": market.rates(spark, d)}
    return reduce(DataFrame.unionByName, (snapshot.content_hash(df).withColumn("part", F.lit(k)) for k, df in tables.items()))


def _merkle_sql(name: str, rows: str, kinds: dict[str, str]) -> str:
    """Common tables of a tree over rows in the order of (date, ticker), level by level."""
    f = snapshot.FANOUT
    up = lambda below, level: f"SELECT {level} AS level, node // {f} AS node, sum(n_rows) AS n_rows, min(first_key) AS first_key, max(last_key) AS last_key, sha256(string_agg(digest, '' ORDER BY node)) AS digest FROM {below} GROUP BY 2"
    leaves = f"SELECT row_number() OVER (ORDER BY date, ticker) - 1 AS node, 1 AS n_rows, date::VARCHAR || ' ' || ticker AS first_key, date::VARCHAR || ' ' || ticker AS last_key, {_row_sql(kinds)} AS digest FROM {rows}"
    return ",\n".join([f"{name}_r AS ({leaves})", f"{name}_0 AS ({up(f'{name}_r', 0)})", f"{name}_1 AS ({up(f'{name}_0', 1)})", f"{name}_2 AS ({up(f'{name}_1', 2)})", f"{name}_3 AS ({up(f'{name}_2', 3)})"])


_TREE = "SELECT * FROM m_0 UNION ALL SELECT * FROM m_1 WHERE (SELECT count(*) FROM m_0) > 1 UNION ALL SELECT * FROM m_2 WHERE (SELECT count(*) FROM m_1) > 1 UNION ALL SELECT * FROM m_3 WHERE (SELECT count(*) FROM m_2) > 1"


def _tree(df: DataFrame) -> DataFrame:
    return snapshot.merkle(df.select("ticker", "date", "close", "volume"), ["date", "ticker"])


def _spelled() -> list:
    return [F.concat_ws(" ", F.col(f"{c}.date").cast("string"), F.col(f"{c}.ticker")).alias(c) for c in ("first_key", "last_key")]


@query("merkle_tree", sql(f"SELECT level, node, n_rows::BIGINT AS n_rows, first_key, last_key, digest FROM ({_TREE})", ["bars"], _merkle_sql("m", "bars", {"ticker": "s", "date": "d", "close": "f", "volume": "f"})))
def _(spark, d):
    """A tree of hashes over the bars in the order of day and ticker; its top is the table's hash."""
    rows = _tree(market.bars(spark, d))
    return rows.select("level", "node", "n_rows", *_spelled(), "digest")


#: A change of one bit: the last of the significand of the closes of one day.
_BIT = "CASE WHEN date = (SELECT min(date) FROM bars WHERE date >= DATE '1996-01-01') AND ticker = (SELECT min(ticker) FROM bars) THEN close + pow(2.0::DOUBLE, floor(log2(close)) - 52) ELSE close END"


@query("merkle_changes", sql("SELECT a.node, a.n_rows::BIGINT AS old_rows, b.n_rows::BIGINT AS new_rows, b.first_key, b.last_key FROM m_0 a JOIN c_0 b USING (node) WHERE a.digest <> b.digest", ["bars"], f"""{_merkle_sql("m", "bars", {"ticker": "s", "date": "d", "close": "f", "volume": "f"})},
bit AS (SELECT ticker, date, {_BIT} AS close, volume FROM bars),
{_merkle_sql("c", "bit", {"ticker": "s", "date": "d", "close": "f", "volume": "f"})}"""))
def _(spark, d):
    """The last bit of one price flipped, and the range of rows that holds it found from the tops of two trees."""
    b = cut(market.bars(spark, d).select("ticker", "date", "close", "volume"), "bars")
    at = b.where("date >= '1996-01-01'").agg(F.min("date").alias("d")).join(b.agg(F.min("ticker").alias("t")))
    bit = F.col("close") + F.pow(F.lit(2.0), F.floor(F.log2("close")) - 52)
    other = b.join(F.broadcast(at)).withColumn("close", F.when((F.col("date") == F.col("d")) & (F.col("ticker") == F.col("t")), bit).otherwise(F.col("close")))
    found = snapshot.changed(_tree(b), _tree(other))
    return found.select("node", "old_rows", "new_rows", *_spelled())


@query("snapshot_roundtrip", sql("SELECT 'prices' AS part, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date FROM bars UNION ALL SELECT 'rates', count(*), min(date), max(date) FROM rates", ["bars", "rates"]))
def _(spark, d):
    """Written in canonical order behind the gate, then loaded again with the integrity check."""
    b, r = cut(market.bars(spark, d), "prices"), cut(market.rates(spark, d), "rates", 1)
    none = b.limit(0).select(F.lit("calendar").alias("check"), F.lit(True).alias("hard"), F.lit(0).alias("findings"), F.lit(True).alias("passed"))
    folder = snapshot.create({"prices": (b, ["date", "ticker"]), "rates": (r, ["date"])}, none, new_path(spark, "snapshots"), "2020-01-01", C)
    loaded = snapshot.load(spark, folder, ["prices", "rates"])
    ends = [F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date")]
    return reduce(DataFrame.unionByName, (df.agg(*ends).select(F.lit(k).alias("part"), "*") for k, df in loaded.items()))


@query("canonical_order", sql("SELECT row_number() OVER (ORDER BY date, ticker) AS place, ticker, date, close FROM bars", ["bars"]))
def _(spark, d):
    """Places in the canonical order, counted by day: the days before, then the rank within the day."""
    b = market.bars(spark, d)
    days = b.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    before = days.select("date", (F.sum("n").over(Window.orderBy("date")) - F.col("n")).alias("before"))  # a row a day
    rank = F.row_number().over(Window.partitionBy("date").orderBy("ticker"))
    return b.withColumn("rank", rank).join(before, "date").select((F.col("before") + F.col("rank")).alias("place"), "ticker", "date", "close")


def _shifted(b: DataFrame, by: float = 1.01) -> DataFrame:
    """Bars with adjusted prices, those of every second week of 1996 off by a hundredth."""
    adjusted = quality.back_adjusted(b, _dividends(b), _splits(b).limit(0)).select("ticker", "date", "adjusted")
    wrong = F.when((F.year("date") == 1996) & (F.weekofyear("date") % 2 == 0), by).otherwise(1.0)
    return b.join(adjusted, ["ticker", "date"]).withColumn("adj_close", F.col("adjusted") * wrong)


_ADJ = """adj AS (SELECT ticker, date, close, dividend, before, close * coalesce(product(CASE WHEN dividend IS NOT NULL AND before IS NOT NULL THEN 1 - dividend / before ELSE 1 END) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1)
  * (CASE WHEN year(date) = 1996 AND weekofyear(date) % 2 = 0 THEN 1.01 ELSE 1 END) AS a FROM fac),
tr AS (SELECT *, a / lag(a) OVER (PARTITION BY ticker ORDER BY date) - 1 AS adj_ret, close / before - 1 + dividend / before AS expected FROM adj)"""


@query("total_return_check", sql(f"SELECT ticker, date, {s6('adj_ret')}, {s6('expected')} FROM tr WHERE ticker = 'Brand#1' AND dividend <> 0 AND abs(adj_ret - expected) > 5e-4", ["bars"], f"{_EVENTS},{_ADJ}"))
def _(spark, d):
    b = _shifted(market.bars(spark, d)).where("ticker = 'Brand#1'")
    snapped = quality.snapped(_dividends(market.bars(spark, d)), market.bars(spark, d)).select("ticker", F.col("date").alias("event_date"), "dividend")
    found = quality.total_return(b, snapped.where("ticker = 'Brand#1'"), 5)
    return found.select("ticker", "date", r6("adj_ret"), r6("expected"))


@query("out_of_order", "SELECT ticker, date, arrival FROM (SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, l_orderkey * 10 + l_linenumber AS arrival, max(CAST(l_shipdate AS DATE)) OVER (PARTITION BY p_brand ORDER BY l_orderkey * 10 + l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE date <= before")
def _(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    raw = spark.read.parquet(f"{d}/lineitem.parquet").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return quality.out_of_order(raw.select(F.col("p_brand").alias("ticker"), F.to_date("l_shipdate").alias("date"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("arrival")), "arrival")


@query("missing_tickers", "SELECT DISTINCT p_type AS ticker FROM part WHERE p_type NOT IN (SELECT p_type FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'O' AND length(p_type) % 2 = 0)")
def _(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    sold = spark.read.parquet(f"{d}/lineitem.parquet").where("l_linestatus = 'O'").join(part, F.col("l_partkey") == F.col("p_partkey")).where("length(p_type) % 2 = 0")
    return quality.missing_tickers(part.select(F.col("p_type").alias("ticker")), sold.select(F.col("p_type").alias("ticker")))


_GATE = """mr AS (SELECT count(*) AS n FROM (SELECT ticker FROM (SELECT ticker, seen, count(CASE WHEN close IS NULL THEN 1 END) AS gap FROM (SELECT *, count(close) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS seen FROM grid) GROUP BY 1, 2) GROUP BY 1 HAVING max(CASE WHEN seen > 0 THEN gap ELSE 0 END) > 3 OR max(seen) = 0)),
er AS (SELECT count(*) AS n FROM (SELECT close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM bars) WHERE abs(ret) > 0.05),
tt AS (SELECT count(*) AS n FROM tr WHERE ticker = 'Brand#1' AND dividend <> 0 AND abs(adj_ret - expected) > 5e-4),
oc AS (SELECT count(*) AS n FROM (SELECT DISTINCT date FROM bars) WHERE date NOT IN (SELECT date FROM rates)),
res AS (SELECT 'total_return' AS "check", TRUE AS hard, n AS findings FROM tt UNION ALL SELECT 'extreme_returns', FALSE, n FROM er UNION ALL SELECT 'missing_values', TRUE, n FROM mr UNION ALL SELECT 'calendar', TRUE, n FROM oc UNION ALL SELECT 'repeated_keys', TRUE, 0)"""


@query("validation_checks", sql('SELECT "check", hard, findings, findings = 0 AS passed FROM res', ["bars", "grid", "rates"], f"{_EVENTS},{_ADJ},{_GATE}"))
def _(spark, d):
    b = cut(market.bars(spark, d), "bars")
    snapped = quality.snapped(_dividends(b), b).select("ticker", F.col("date").alias("event_date"), "dividend")
    return snapshot.checks(cut(_shifted(b), "shifted"), market.rates(spark, d).select("date"), snapped, "Brand#1", 0.05, 3, 5)


def _gated_sql(attempt: str, by: str, calendar: str = "rates") -> str:
    failed = "string_agg(\"check\", ', ' ORDER BY \"check\") FILTER (hard AND findings > 0)"
    return f"SELECT '{attempt}' AS attempt, {failed} IS NULL AS written, 'hard checks failed: ' || {failed} AS reason FROM (WITH {_ADJ.replace('1.01', by)},{_GATE.replace('FROM rates', f'FROM {calendar}')} SELECT * FROM res)"


@query("snapshot_gate", sql(f"{_gated_sql('shifted', '1.01')} UNION ALL {_gated_sql('given', '1.0')} UNION ALL {_gated_sql('own_days', '1.0', 'bars')}", ["bars", "grid", "rates"], _EVENTS))
def _(spark, d):
    """The bars with wrong and with right adjusted prices against the rates' days, and against their own: what a hard check
    stops is not written."""
    b, calendar = cut(market.bars(spark, d), "bars"), market.rates(spark, d).select("date")
    snapped = quality.snapped(_dividends(b), b).select("ticker", F.col("date").alias("event_date"), "dividend")
    rows = []
    for attempt, by, days in (("shifted", 1.01, calendar), ("given", 1.0, calendar), ("own_days", 1.0, b.select("date").distinct())):
        bars, root = cut(_shifted(b, by), attempt), new_path(spark, "gated")
        try:
            folder = snapshot.create({"prices": (bars, ["date", "ticker"])}, snapshot.checks(bars, days, snapped, "Brand#1", 0.05, 3, 5), root, "2020-01-01", C)
            rows.append((attempt, snapshot.load(spark, folder, ["prices"])["prices"].count() == bars.count(), None))
        except ValueError as error:
            rows.append((attempt, False, str(error)))
    return spark.createDataFrame(rows, "attempt string, written boolean, reason string")


@query("data_quality", sql(f"""SELECT 'manifest' AS section, 'config' AS key, '{snapshot.config_hash(C)}' AS value UNION ALL SELECT 'manifest', 'prices', content FROM ({_content_sql('(SELECT *, close AS adj_close FROM bars)', _KINDS)})
  UNION ALL SELECT 'checks', 'extreme_returns', 'soft, ' || (SELECT count(*) FROM (SELECT close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM bars) WHERE abs(ret) > 0.05) || ' findings' UNION ALL SELECT 'checks', 'repeated_keys', 'hard, 0 findings'
  UNION ALL SELECT 'tickers', ticker, min(date)::VARCHAR || ' ' || max(date)::VARCHAR || ' ' || count(*) FROM bars GROUP BY 2""", ["bars"]))
def _(spark, d):
    """The data-quality page of a snapshot of the bars, behind the checks that need nothing but them."""
    b = cut(market.bars(spark, d), "bars")
    seen = snapshot.checks(b, b.select("date"), _dividends(b).limit(0), "Brand#1", 0.05, 3, 5).where("check in ('extreme_returns', 'repeated_keys')")
    return snapshot.described(spark, snapshot.create({"prices": (b, ["date", "ticker"])}, seen, new_path(spark, "snapshots"), "2020-01-01", C))


@query("json_safe", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{}' ELSE '{\"v\":' || (event_id % 100) || '}' END AS body FROM events")
def _(spark, d):
    odd = F.when(F.col("event_id") % 6 == 0, float("nan")).when(F.col("event_id") % 3 == 0, float("inf")).otherwise((F.col("event_id") % 100).cast("double"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.to_json(F.struct(snapshot.json_safe(odd).cast("int").alias("v"))).alias("body"))


@query("last_close", sql("SELECT ticker, max(date) AS date, arg_max(close, date) AS close FROM bars WHERE date <= DATE '1997-06-30' GROUP BY 1", ["bars"]))
def _(spark, d):
    return market.last_close(market.bars(spark, d), "1997-06-30")
