"""Parsers, snapshots, checks and the read layer on small tables."""

from __future__ import annotations

import hashlib
import json
import shutil
from datetime import date
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import quality
from plumbline.operators.backtest import Book
from plumbline.operators.signals import Config
from plumbline.plans import readers
from plumbline.sources import market, snapshot, vendors

BARS = [("A", date(2020, 1, i), float(10 + i), float(10 + i)) for i in (1, 2, 3, 6)] + [("B", date(2020, 1, i), 5.0, 5.0) for i in (1, 2, 3, 6)]


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(BARS, "ticker string, date date, close double, adj_close double")


def test_parsers(spark):
    tiingo = [("A", '[{"date":"2020-01-02T00:00:00.000Z","close":1.5,"adjClose":1.25,"volume":7}]'), ("B", "[]"), ("C", None)]
    got = [tuple(r) for r in vendors.tiingo(spark.createDataFrame(tiingo, "ticker string, payload string")).collect()]
    assert got == [(date(2020, 1, 2), "A", 1.5, 1.25, 7.0)]
    twelve = [("A", '{"values":[{"datetime":"2020-01-02","close":"1.5","volume":"7"}]}'), ("B", '{"values":[]}')]
    assert [tuple(r) for r in vendors.twelvedata(spark.createDataFrame(twelve, "ticker string, payload string")).collect()] == [(date(2020, 1, 2), "A", 1.5, None, 7.0)]
    stooq = [("A", "Date,Open,High,Low,Close,Volume\r\n2020-01-02,1,2,0.5,1.5,7\r\n"), ("B", "Date,Open,High,Low,Close,Volume"), ("C", None)]
    assert [tuple(r) for r in vendors.stooq(spark.createDataFrame(stooq, "ticker string, payload string")).collect()] == [(date(2020, 1, 2), "A", 1.5, None, 7.0)]
    fred = spark.createDataFrame([("DATE,DTB3",), ("2020-01-03,.",), ("2020-01-02,1.5",)], "line string")
    assert [tuple(r) for r in vendors.fred(fred, "DTB3").collect()] == [(date(2020, 1, 2), 1.5), (date(2020, 1, 3), None)]
    assert vendors.empty_prices(spark).count() == 0
    url = spark.createDataFrame([("https://h/p?token=abc&x=1 apikey=zz",)], "u string").select(vendors.redacted(F.col("u"))).first()[0]
    assert url == "https://h/p?token=***&x=1 apikey=***"


def test_content_hash_knows_rows_not_order(spark, bars):
    h = lambda df: snapshot.content_hash(df).first()["content"]
    assert h(bars) == h(bars.orderBy(F.desc("close")).select("close", "date", "adj_close", "ticker"))
    assert h(bars) != h(bars.withColumn("close", F.col("close") + 1e-3)) and h(bars) != h(bars.unionByName(bars.limit(1)))
    nan = spark.createDataFrame([(float("nan"),), (0.0,)], "x double")
    assert h(nan) == h(spark.createDataFrame([(None,), (-0.0,)], "x double"))


def test_snapshot_gate_and_integrity(spark, bars, tmp_path):
    calendar = bars.select("date").distinct()
    paid = spark.createDataFrame([], "ticker string, event_date date, dividend double")
    ok = snapshot.checks(bars, calendar, paid, "A", 0.5, 1, 5)
    folder = snapshot.create({"prices": (bars, ["date", "ticker"])}, ok, str(tmp_path), "2020-01-06", Config())
    assert snapshot.load(spark, folder, ["prices"])["prices"].count() == len(BARS)
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        snapshot.create({"prices": (bars, ["date", "ticker"])}, ok, str(tmp_path), "2020-01-06", Config())
    bad = snapshot.checks(bars, calendar.where("date < '2020-01-06'"), paid, "A", 0.5, 1, 5)
    with pytest.raises(ValueError, match="calendar"):
        snapshot.create({"prices": (bars, ["date", "ticker"])}, bad, str(tmp_path), "2020-01-07", Config())
    bars.withColumn("close", F.col("close") + 1).write.mode("append").parquet(f"{folder}/prices")
    with pytest.raises(ValueError, match="prices"):
        snapshot.load(spark, folder, ["prices"])


def test_total_return_and_order(spark, bars):
    paid = spark.createDataFrame([("A", date(2020, 1, 3), 1.0)], "ticker string, event_date date, dividend double")
    one = bars.where("ticker = 'A'")
    assert [r.date for r in quality.total_return(one, paid, 5).collect()] == [date(2020, 1, 3)]
    assert quality.total_return(one.withColumn("adj_close", F.when(F.col("date") >= "2020-01-03", F.col("close") * 12 / 11 + F.when(F.col("date") == "2020-01-03", 0.0).otherwise(0.0)).otherwise(F.col("close"))), paid, 2000).count() == 0
    with pytest.raises(Exception, match="one ticker"):
        quality.total_return(bars, paid, 5).collect()
    rows = [("A", date(2020, 1, d), i) for i, d in enumerate((1, 3, 2, 3, 4))]
    got = quality.out_of_order(spark.createDataFrame(rows, "ticker string, date date, arrival int"), "arrival")
    assert sorted(r.arrival for r in got.collect()) == [2, 3]


def test_last_close_and_config(bars, tmp_path):
    assert {r.ticker: r.close for r in market.last_close(bars, "2020-01-04").collect()} == {"A": 13.0, "B": 5.0}
    with pytest.raises(Exception, match="no price"):
        market.last_close(bars, "2019-01-01").collect()
    file = tmp_path / "c.json"
    file.write_text(json.dumps({"top_k": 3, "band": 0.2}))
    assert snapshot.load_config(str(file)) == Config(top_k=3, band=0.2)
    for bad in ({"topk": 3}, {"top_k": "3"}, {"top_k": True}, {"lam": 1.5}, {"band_mode": "x"}, {"check": 9}):
        file.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            snapshot.load_config(str(file))
    assert snapshot.config_hash(Config()) == snapshot.config_hash(Config()) != snapshot.config_hash(Config(top_k=4))
    assert snapshot.combined_hash({"b": "1", "a": "2"}) == snapshot.combined_hash({"a": "2", "b": "1"})


def test_decisions_as_json_and_back(spark):
    rows = spark.createDataFrame(
        [("s", 5, 6, "B", 1, 0.5, True, 0.75), ("s", 5, 6, "A", 2, 0.25, False, 0.25), ("s", 9, None, "A", 1, 0.1, True, 1.0)],
        "strategy_id string, decision_idx int, exec_idx int, ticker string, rank int, score double, passes boolean, weight double",
    )
    flat = readers.flat_decisions(rows)
    first = flat.where("decision_idx = 5").first()
    assert (first.selected, first.w_risky, first.absmom) == ('["B", "A"]', '{"A": 0.250000, "B": 0.750000}', '{"A": false, "B": true}')
    assert {(r.decision_idx, r.ticker, r.weight, r.passes) for r in readers.parsed_decisions(flat).collect()} == {(5, "A", 0.25, False), (5, "B", 0.75, True), (9, "A", 1.0, True)}
    assert {r.decision_idx: r.cash for r in readers.cash_fraction(flat).collect()} == {5: 0.25, 9: 0.0}
    missing = flat.withColumn("absmom", F.lit('{"B": true}'))
    assert {r.decision_idx: r.cash for r in readers.cash_fraction(missing).collect()} == {5: 0.25, 9: 1.0}
    assert readers.decision_at(flat, "s", 9).first().decision_idx == 9 and readers.decision_at(flat, "s", 7).count() == 0
    with pytest.raises(Exception, match="more than one"):
        readers.decision_at(flat.unionByName(flat), "s", 5).collect()


def test_governing_selection_is_the_one_before_the_day(spark):
    cash = spark.createDataFrame([(2, 0.0), (4, 0.9)], "exec_idx int, cash double")
    nav = spark.createDataFrame([(i, 0.01 * (-1) ** i) for i in range(1, 7)], "idx int, raw double")
    got = {r.threshold: r for r in readers.conditional_vol(cash, nav, [0.0, 0.9], 0.1, 0.02).collect()}
    assert (got[0.0].n_included, got[0.9].n_included, got[0.0].n_total) == (2, 4, 6)  # days 3 and 4; then 5 and 6 too


def test_absent_artifacts(spark, tmp_path):
    assert readers.load(spark, str(tmp_path), "nav") is None
    assert readers.catalogue(spark, str(tmp_path), ["none"]).count() == 0


def test_doubles_are_hashed_bit_for_bit(spark):
    rng = np.random.default_rng(4)
    some = np.frombuffer(rng.bytes(8 * 4000), dtype="float64")
    values = [float(x) for x in some if np.isfinite(x)] + [2.0**e for e in range(-1074, 1024)] + [np.nextafter(2.0**e, 0) for e in range(-1073, 1024)] + [-5e-324, 1.7976931348623157e308]
    got = spark.createDataFrame([(float(v),) for v in values], "x double").select("x", snapshot.exact(F.col("x")).alias("t")).collect()
    for r in got:
        m, e = r.t[1:].split("p")
        assert 2**52 <= int(m) < 2**53 and Fraction(int(m)) * Fraction(2) ** (int(e) - 52) == abs(Fraction(r.x)) and (r.t[0] == "-") == (r.x < 0)
    odd = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (None,), (float("inf"),), (float("-inf"),)], "x double")
    assert [r.t for r in odd.select(snapshot.exact(F.col("x")).alias("t")).collect()] == ["0", "0", "null", "null", "+inf", "-inf"]


def _tree_of(rows: list[str], fanout: int) -> list[list[str]]:
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    levels = [rows]
    while len(levels) == 1 or len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return levels[1:]


def test_tree_of_hashes(spark):
    df = spark.createDataFrame([(i // 3, f"k{i % 3}", i / 7) for i in range(100)], "day int, ticker string, x double").repartition(5)
    digest = [r.d for r in df.select("day", "ticker", snapshot.row_digest(df).alias("d")).orderBy("day", "ticker").collect()]
    got = snapshot.merkle(df, ["day", "ticker"], 4).collect()
    want = _tree_of(digest, 4)
    assert {(r.level, r.node): r.digest for r in got} == {(i, j): d for i, level in enumerate(want) for j, d in enumerate(level)}
    assert {r.level: sum(x.n_rows for x in got if x.level == r.level) for r in got} == {i: 100 for i in range(len(want))}
    first = next(r for r in got if (r.level, r.node) == (0, 1))
    assert (tuple(first.first_key), tuple(first.last_key)) == ((1, "k1"), (2, "k1"))
    assert snapshot.root(snapshot.merkle(df.orderBy("x"), ["day", "ticker"], 4)).first().content == want[-1][0]


def test_a_changed_bit_is_found_in_its_range(spark):
    rows = [(i, 1.0 + i) for i in range(50)]
    tree = lambda r: snapshot.merkle(spark.createDataFrame(r, "k int, x double"), ["k"], 3)
    old = tree(rows)
    bit = [(k, float(np.nextafter(x, 9e9)) if k == 31 else x) for k, x in rows]
    assert [(r.node, r.first_key.k, r.last_key.k) for r in snapshot.changed(old, tree(bit), 3).collect()] == [(10, 30, 32)]
    assert snapshot.changed(old, tree(rows[::-1]), 3).count() == 0
    less = snapshot.changed(old, tree([r for r in rows if r[0] != 20]), 3).collect()
    assert min(r.node for r in less) == 6 and len(less) == 11
    nothing = tree([])
    assert (nothing.count(), snapshot.root(nothing).first().content) == (1, hashlib.sha256(b"").hexdigest())
    assert snapshot.changed(nothing, old, 3).count() == 17
    twins = tree([(1, 2.0)] * 10)
    assert sum(r.n_rows for r in twins.where("level = 0").collect()) == 10


def test_runs_are_found_checked_and_ordered(spark, tmp_path):
    nav = spark.createDataFrame([("a+b c", i, 1.0 + i) for i in range(5)] + [("z", 0, 1.0)], "strategy_id string, idx int, nav double")
    trades = nav.where("idx = 0").select("strategy_id", "idx")
    book, root = Book(nav, nav.select("strategy_id", "idx"), trades), f"{tmp_path}/my runs"
    assert readers.runs(spark, root).count() == 0 and readers.found_artifacts(spark, root).count() == 0
    with pytest.raises(ValueError, match="no complete run"):
        readers.newest_run(spark, root)
    readers.write_run(book, f"{root}/1 first", Config(), comparison=trades)
    assert readers.newest_run(spark, root) == f"{root}/1 first"
    readers.write_run(book, f"{root}/0+second", Config())
    nav.write.partitionBy("strategy_id").parquet(f"{root}/torn/nav")
    readers.write_run(book, f"{root}/lost", Config())
    shutil.rmtree(f"{root}/lost/trades")
    got = {r.run: r for r in readers.runs(spark, root).collect()}
    assert {k: (r.complete, r.reason, r.newest) for k, r in got.items()} == {
        "1 first": (True, None, False), "0+second": (True, None, True), "torn": (False, "no manifest", False), "lost": (False, "rows differ: trades", False),
    }
    assert got["1 first"].modified <= got["0+second"].modified and all(r.bytes > 0 and r.n_files > 0 for r in got.values())
    assert readers.newest_run(spark, root) == f"{root}/0+second"
    rows = {(r.run, r.artifact, r.strategy_id): r.n_rows for r in readers.found_artifacts(spark, root).collect()}
    assert rows["1 first", "nav", "a+b c"] == 5 and rows["torn", "nav", "z"] == 1 and rows["1 first", "comparison", "z"] == 1 and ("lost", "trades", "z") not in rows
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        readers.write_run(book, f"{root}/1 first", Config())
    with pytest.raises(ValueError, match="unknown artefacts"):
        readers.write_run(book, f"{root}/2", Config(), notes=trades)


def test_csv_starts_with_the_byte_order_mark(spark, tmp_path):
    rows = [(1, "Zürich", 0.5), (2, 'a, "b"', None)]
    df = spark.createDataFrame(rows, "idx int, ticker string, weight double").coalesce(1)
    readers.write_csv(df, f"{tmp_path}/csv")
    (part,) = tmp_path.glob("csv/part-*.csv")
    assert part.read_bytes().startswith(b"\xef\xbb\xbfidx,ticker,weight")
    assert sorted(map(tuple, readers.read_csv(spark, f"{tmp_path}/csv", "idx int, ticker string, weight double").collect())) == rows


def test_heat_map_is_dense_and_ordered_by_mean_weight(spark):
    w = spark.createDataFrame([(1, "b", 0.6), (1, "a", 0.4), (2, "c", 1.0), (3, "b", 0.4), (3, "a", 0.6)], "idx int, ticker string, weight double")
    got = readers.heatmap(w).collect()
    assert {r.ticker: r.place for r in got} == {"a": 1, "b": 2, "c": 3}  # all means are a third: by ticker
    assert len(got) == 9 and {(r.idx, r.ticker): r.weight for r in got}[2, "a"] == 0.0
    assert readers.heatmap(w.limit(0)).count() == 0


def test_overview_has_all_strategies_and_periods_of_the_first(spark):
    nav = spark.createDataFrame([(s, i, 1.0 + k * i / 100, 0.0, 0.0) for k, s in enumerate(("x", "y", "z")) for i in range(6)], "strategy_id string, idx int, nav double, turnover double, cost double")
    weights = nav.select("strategy_id", "idx").withColumn("ticker", F.lit("A")).withColumn("weight", F.lit(1.0))
    rf = spark.range(6).select(F.col("id").cast("int").alias("idx"), F.lit(0.0).alias("rf"))
    spans = rf.select("idx", F.when(F.col("idx") < 2, "early").otherwise("late").alias("period"))
    got = {(r.part, r.strategy_id, r.period): r.n_days for r in readers.overview(nav, weights, rf, spans, ["y", "x", "absent"]).collect()}
    assert got == {("metrics", "x", "all"): 6, ("metrics", "y", "all"): 6, ("subperiod", "y", "early"): 2, ("subperiod", "y", "late"): 4}


def test_snapshot_describes_itself(spark, bars, tmp_path):
    paid = spark.createDataFrame([], "ticker string, event_date date, dividend double")
    ok = snapshot.checks(bars, bars.select("date").distinct(), paid, "A", 0.5, 1, 5)
    folder = snapshot.create({"prices": (bars, ["date", "ticker"])}, ok, str(tmp_path), "2020-01-06", Config())
    rows = {(r.section, r.key): r.value for r in snapshot.described(spark, folder).collect()}
    assert rows["manifest", "config"] == snapshot.config_hash(Config()) and rows["checks", "calendar"] == "hard, 0 findings"
    assert {k for s, k in rows if s == "tickers"} == {r.ticker for r in bars.select("ticker").distinct().collect()}
    assert sum(int(v.split()[-1]) for (s, _), v in rows.items() if s == "tickers") == len(BARS)
