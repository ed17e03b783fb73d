"""Known answers and invariants of the engine's operators."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.plans import strategies
from plumbline.operators import backtest, metrics, portfolio, quality, signals, stats, volatility
from plumbline.sources import market

DAY = date(2024, 1, 1)


def _panel(spark, prices):
    rows = [(t, DAY + timedelta(i), i, float(p)) for t, ps in prices.items() for i, p in enumerate(ps) if p is not None]
    return market.with_returns(spark.createDataFrame(rows, "ticker string, date date, idx int, p double"))


def test_three_day_account(spark):
    """Cash interest on the first day, costs after the day's return, drift on the third."""
    panel = _panel(spark, {"A": [100, 100, 110], "B": [100, 100, 95.0]})
    rf = spark.createDataFrame([(DAY + timedelta(i), i, 0.0001) for i in range(3)], "date date, idx int, rf double")
    targets = spark.createDataFrame([("s", 1, "A", 0.6), ("s", 1, "B", 0.4)], "strategy_id string, exec_idx int, ticker string, weight double")
    book = backtest.run(targets, panel, rf, 0, 2, 5.0)
    nav = {r.idx: r for r in book.nav.collect()}
    assert nav[0].nav == pytest.approx(1.0001)
    assert nav[1].turnover == pytest.approx(1.0) and nav[1].cost == pytest.approx(0.000500100005) and nav[1].nav == pytest.approx(0.999699909995)
    assert nav[2].nav == pytest.approx(1.0396879063948)
    weights = {r.ticker: r.weight for r in book.weights.where("idx = 2").collect()}
    assert weights["A"] == pytest.approx(0.6346153846153846) and weights["B"] == pytest.approx(0.3653846153846154)
    assert sum(r.cost for r in book.trades.collect()) == pytest.approx(nav[1].cost)


def test_closed_form_equals_daily_loop(spark):
    rng = np.random.default_rng(3)
    n, names = 40, ["A", "B", "C"]
    prices = {t: 100 * np.cumprod(1 + rng.normal(0, 0.02, n)) for t in names}
    panel = _panel(spark, prices)
    rf = spark.createDataFrame([(DAY + timedelta(i), i, 0.0001) for i in range(n)], "date date, idx int, rf double")
    plans = {4: {"A": 0.5, "B": 0.5}, 11: {"C": 0.7, "CASH": 0.3}, 25: {"A": 0.2, "B": 0.3, "C": 0.5}}
    targets = spark.createDataFrame([("s", k, t, w) for k, p in plans.items() for t, w in p.items()], "strategy_id string, exec_idx int, ticker string, weight double")
    got = {r.idx: r.nav for r in backtest.run(targets, panel, rf, 1, n - 1, 5.0).nav.collect()}
    nav, w = 1.0, {"CASH": 1.0}
    for t in range(1, n):
        r = {x: prices[x][t] / prices[x][t - 1] - 1 for x in names} | {"CASH": 0.0001}
        total = sum(v * (1 + r[x]) for x, v in w.items())
        nav, w = nav * total, {x: v * (1 + r[x]) / total for x, v in w.items()}
        if t in plans:
            nav *= 1 - 5e-4 * sum(abs(plans[t].get(x, 0) - w.get(x, 0)) for x in names)
            w = plans[t]
        assert got[t] == pytest.approx(nav, rel=1e-12)


def test_top_k_ties_and_routing(spark):
    s = spark.createDataFrame([(DAY, "B", 0.1, True), (DAY, "A", 0.1, False), (DAY, "C", None, True), (DAY, "D", 0.3, True)], "date date, ticker string, score double, passes boolean")
    top = signals.top_k(s, 2)
    assert sorted(r.ticker for r in top.collect()) == ["A", "D"]
    routed = {r.ticker: r.weight for r in portfolio.route_to_cash(portfolio.equal_weight(top, ["date"]), ["date"]).collect()}
    assert routed == {"D": 0.5, "CASH": 0.5}


def test_band_blocks_on_equality(spark):
    rows = spark.createDataFrame([(0, 0, 0.5), (0, 2, 0.625), (0, 4, 0.75), (0, 6, 0.76), (1, 8, 0.2)], "epoch int, idx int, e double")
    got = {r.idx: (r.applied, r.blocked) for r in portfolio.banded(rows, ["epoch"], "idx", "e", F.lit(0.125), F.lit("absolute")).collect()}
    assert got == {0: (0.5, False), 2: (0.5, True), 4: (0.75, False), 6: (0.75, True), 8: (0.2, False)}


def test_no_look_ahead(spark):
    prices = {t: 100 * np.cumprod(1 + np.random.default_rng(i).normal(0, 0.02, 80)) for i, t in enumerate("ABC")}
    cut = {t: np.append(p[:70], p[70:] * 3) for t, p in prices.items()}
    cfg = signals.Config(lookback=20, skip=2, min_history=21, top_k=2)
    a, b = (signals.momentum(_panel(spark, p), cfg).where("idx < 70").orderBy("ticker", "idx").collect() for p in (prices, cut))
    assert a == b


def test_erc_fold_is_the_descent(spark):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for day, k in ((1, 1), (2, 2), (3, 6)):
        a = rng.normal(0, 0.1, (k, k + 3))
        cov = a @ a.T
        names = [f"T{i}" for i in range(k)]
        rows += [(day, x, y, float(cov[i, j])) for i, x in enumerate(names) for j, y in enumerate(names)]
        want |= {(day, t): w for t, w in zip(names, portfolio.erc(cov), strict=True)}
    df = spark.createDataFrame(rows, "day int, ticker_i string, ticker_j string, cov double")
    assert {(r.day, r.ticker): r.weight for r in portfolio.erc_weights(df, "day").collect()} == pytest.approx(want, abs=1e-8)
    with pytest.raises(Exception, match="did not converge"):
        portfolio.erc_weights(df.where("day = 3"), "day", 1).collect()


def test_erc_contributions_are_equal():
    cov = np.array([[0.04, 0.01, 0.0], [0.01, 0.09, 0.02], [0.0, 0.02, 0.16]])
    w = portfolio.erc(cov)
    share = w * (cov @ w)
    assert np.allclose(share, share[0]) and w.sum() == pytest.approx(1)
    two = portfolio.erc(np.array([[0.04, 0.01], [0.01, 0.09]]))
    assert np.allclose(two, np.array([1 / 0.2, 1 / 0.3]) / (1 / 0.2 + 1 / 0.3))


def test_ewma_equals_recursion(spark):
    r = np.random.default_rng(5).normal(0, 0.01, 60)
    p = np.append(100, 100 * np.cumprod(1 + r))
    got = volatility.ewma(_panel(spark, {"A": p}), 0.94).orderBy("idx").collect()[-1].variance
    r = p[1:] / p[:-1] - 1
    h = r.var(ddof=1)
    for x in r:
        h = 0.94 * h + 0.06 * x * x
    assert got == pytest.approx(h, rel=1e-10)


def test_garch_recovers_parameters():
    rng = np.random.default_rng(11)
    n, omega, alpha, beta, nu = 4000, 0.05, 0.08, 0.88, 7.0
    x, h = np.empty(n), omega / (1 - alpha - beta)
    for i in range(n):
        x[i] = np.sqrt(h) * rng.standard_t(nu) * np.sqrt((nu - 2) / nu)
        h = omega + alpha * x[i] ** 2 + beta * h
    fit = volatility.fit_garch(x / 100)
    assert abs(fit["alpha"] - alpha) < 0.04 and abs(fit["beta"] - beta) < 0.06 and 4 < fit["nu"] < 12
    path, v = [], fit["next_variance"]
    p = fit["alpha"] + fit["beta"]
    for _ in range(21):
        path.append(v)
        v = fit["omega"] + p * v
    assert volatility.mean_forecast(fit["next_variance"], fit["omega"], p, 21) == pytest.approx(np.mean(path))
    with pytest.raises(ValueError):
        volatility.fit_garch(x[:50])


def test_gaps_and_adjustment(spark):
    grid = spark.createDataFrame([("A", DAY + timedelta(i), c) for i, c in enumerate([None, 1.0, None, None, 2.0, None])], "ticker string, date date, close double")
    assert [tuple(r) for r in quality.missing_runs(grid, 2).collect()] == [("A", 2, False)]
    bars = spark.createDataFrame([("A", DAY + timedelta(i), c) for i, c in ((0, 10.0), (2, 10.0), (3, 5.0))], "ticker string, date date, close double")
    div = spark.createDataFrame([("A", DAY + timedelta(1), 1.0), ("A", DAY + timedelta(9), 1.0)], "ticker string, event_date date, dividend double")
    spl = spark.createDataFrame([("A", DAY + timedelta(3), 2.0)], "ticker string, event_date date, ratio double")
    got = [r.adjusted for r in quality.back_adjusted(bars, div, spl).orderBy("date").collect()]
    assert got == pytest.approx([10 * 0.9 / 2, 5.0, 5.0])


def test_overfitting_equals_brute_force(spark):
    from itertools import combinations

    rng = np.random.default_rng(2)
    r = {s: rng.normal(0.001 * i, 0.02, 48) for i, s in enumerate("abcde")}
    df = spark.createDataFrame([(s, i, float(x)) for s, v in r.items() for i, x in enumerate(v)], "strategy_id string, idx int, ret double")
    got = {x.combo: (x.best, x.omega) for x in stats.overfitting(df, 6).collect()}
    for c in combinations(range(6), 3):
        k = sum(1 << i for i in c)
        inside = np.isin(np.arange(48) // 8, c)
        f = lambda v: v.mean() / v.std(ddof=1)
        best = max(r, key=lambda s: f(r[s][inside]))
        rank = 1 + sum(f(v[~inside]) < f(r[best][~inside]) for v in r.values())
        assert got[k][0] == best and got[k][1] == pytest.approx(rank / 6)


def test_bootstrap_blocks_and_interval(spark):
    rows = stats.bootstrap_days(spark, 400, 10, 20, 7).collect()
    assert len(rows) == 4000 and {(r.rep, r.t) for r in rows} == {(i, t) for i in range(10) for t in range(400)}
    at = {(r.rep, r.t): r.at for r in rows}
    breaks = sum((at[i, t] - at[i, t - 1]) % 400 != 1 for i in range(10) for t in range(1, 400))
    assert 130 < breaks < 270 and all(0 <= x < 400 for x in at.values())
    assert sorted(at.items()) == sorted(((r.rep, r.t), r.at) for r in stats.bootstrap_days(spark, 400, 10, 20, 7).collect())
    lo, hi, zero = stats.interval("x", 0.1)
    out = spark.createDataFrame([*((float(i),) for i in range(1, 102)), (float("nan"),), (float("inf"),)], "x double").agg(lo, hi, zero).first()
    assert (out.lo, out.hi, out.excludes_zero) == (6.0, 96.0, True)


def _returns(spark, n=60):
    rng = np.random.default_rng(3)
    r = {s: rng.normal(0.001 * i, 0.01, n) for i, s in enumerate("ab")}
    return r, spark.createDataFrame([(s, i, float(x), float(x) - 1e-4) for s, v in r.items() for i, x in enumerate(v)], "strategy_id string, t int, ret double, excess double")


def _numbers(r):
    e = r - 1e-4
    nav = np.append(1.0, np.cumprod(1 + r))
    fall = (nav / np.maximum.accumulate(nav) - 1).min()
    return {"sharpe": e.mean() / e.std(ddof=1) * 252**0.5, "max_drawdown": fall, "calmar": (nav[-1] ** (252 / len(r)) - 1) / abs(fall)}


def test_bootstrap_and_permutation_equal_numpy(spark):
    r, df = _returns(spark)
    days = {}
    for x in stats.bootstrap_days(spark, 60, 5, 10, 42).collect():
        days.setdefault(x.rep, {})[x.t] = x.at
    got = {(x.rep, x.strategy_id, x.metric): x.value for x in stats.bootstrap(df, 5, 10, 42).collect()}
    for rep, at in days.items():
        order = [at[t] for t in range(60)]
        for s, v in r.items():
            for metric, value in _numbers(v[order]).items():
                assert got[rep, s, metric] == pytest.approx(value)
    swaps = {}
    for x in stats.swapped_days(spark, 60, 5, 10, 42).collect():
        swaps.setdefault(x.rep, {})[x.t] = x.swap
    pairs = spark.createDataFrame([("b", "a")], "left string, right string")
    drawn = {(x.rep, x.metric): x.diff for x in stats.permutation(df, pairs, 5, 10, 42).collect()}
    for rep, mask in swaps.items():
        m = np.array([mask[t] for t in range(60)])
        left, right = _numbers(np.where(m, r["a"], r["b"])), _numbers(np.where(m, r["b"], r["a"]))
        for metric in left:
            assert drawn[rep, metric] == pytest.approx(left[metric] - right[metric])
    observed = stats.pair_differences(stats.long_metrics(stats.sample_metrics(df, ["strategy_id"]), ["strategy_id"]), pairs, [])
    p = {x.metric: x.p_value for x in stats.p_values(stats.permutation(df, pairs, 5, 10, 42), observed).collect()}
    assert set(p) == set(stats.METRICS) and all(1 / 6 <= v <= 1 for v in p.values())


def test_pareto_front(spark):
    pts = spark.createDataFrame([("a", 1.0, 3.0), ("b", 2.0, 2.0), ("c", 2.5, 2.5), ("d", 3.0, 1.0)], "strategy_id string, x double, y double")
    assert sorted(r.strategy_id for r in stats.pareto_front(pts, "x", "y").collect()) == ["a", "b", "d"]


def test_cells_that_cannot_run_have_a_reason(spark):
    rows = [("a", 0.1, 0.1, "log"), ("b", 0.0, 0.1, "log"), ("c", None, 0.1, "log"), ("d", 0.1, -1.0, "log"), ("e", 0.1, 0.0, "cubic"), ("f", 0.1, 0.0, None), ("g", 0.2, 0.0, "absolute")]
    df = spark.createDataFrame(rows, "cell string, sigma_star double, band double, band_mode string")
    got = {r.cell: r.reason for r in df.withColumn("reason", strategies.cell_reason()).collect()}
    assert got["a"] is None and "positive" in got["b"] and "positive" in got["c"] and "negative" in got["d"]
    assert got["e"].endswith(": cubic") and got["f"].endswith(": null")
    with pytest.raises(ValueError, match="unknown strategy"):
        strategies.grid_book(None, "nothing", df)


def test_no_strategy_looks_ahead(spark):
    """The panel cut at several days: no target up to it changes, whatever the volatility model."""
    out = strategies.look_ahead(spark, "/root/testdata/sf0.001", ("mom_ivol", "voltarget_only", "full", "full_gjr"), 160, 1e-6).collect()
    assert all(r.compared > 0 and r.differing == 0 for r in out) and len(out) == 4


def test_strategies_of_different_lengths_are_an_error(spark):
    r = spark.createDataFrame([(s, i, 0.01, 0.0) for s, n in (("a", 3), ("b", 3), ("c", 2)) for i in range(n)], "strategy_id string, idx int, ret double, excess double")
    assert stats.aligned(r.where("strategy_id <> 'c'")).count() == 6 and stats.aligned(r.limit(0)).count() == 0
    with pytest.raises(Exception, match="differ in their number of days: 2 to 3"):
        stats.aligned(r).collect()


def test_moments_of_a_book_in_cash_are_unknown(spark):
    rows = spark.createDataFrame([("s", i, 1e-4 + (-1) ** i * 1e-17, 1e-4) for i in range(8)], "strategy_id string, idx int, ret double, rf double")
    got = stats.moments(rows.withColumn("excess", metrics.over_cash(F.col("ret"), F.col("rf"))), "excess").first()
    assert got.n == 8 and got.sr is None


def test_front_keeps_equal_points(spark):
    rows = [("a", 1.0, 0.5), ("b", 1.0, 0.5), ("c", 1.0 + 1e-16, 0.5 + 1e-16), ("d", 1.0, 0.6), ("e", 2.0, 0.5), ("f", 2.0, 0.4), ("g", 2.0 + 4e-16, 0.4)]
    got = stats.pareto_front(spark.createDataFrame(rows, "k string, x double, y double"), "x", "y")
    assert {r.k for r in got.collect()} == {"a", "b", "c", "f", "g"}


def test_rows_that_arrive_together_count_in_order_of_date(spark):
    rows = [("A", DAY + timedelta(k), n) for k, n in ((5, 1), (9, 2), (7, 2), (8, 2), (9, 3))]
    for given in (rows, rows[::-1]):
        got = quality.out_of_order(spark.createDataFrame(given, "ticker string, date date, arrival int"), "arrival")
        assert [(r.date, r.arrival) for r in got.collect()] == [(DAY + timedelta(9), 3)]


def test_overfitting_ranks_equal_series_alike_whatever_the_order_of_their_rows(spark):
    days = [(i, 0.1 + 0.37 * ((i * 7919) % 101) / 101) for i in range(64)]
    there, back = [("a", i, x) for i, x in days], [("b", i, x) for i, x in reversed(days)]
    got = stats.overfitting(spark.createDataFrame(there + back, "strategy_id string, idx int, ret double").coalesce(1), 8).collect()
    assert len(got) == 70 and {(r.best, round(r.omega, 9)) for r in got} == {("a", round(1 / 3, 9))}
