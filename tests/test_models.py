"""Decayed sums, filters, correlation models and their known answers."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import decay
from plumbline.operators import backtest, correlation, likelihood, portfolio, stats, volatility


@pytest.mark.parametrize("lam", [0.0, 0.3, 0.94, 0.999])
def test_decayed_sum_neither_overflows_nor_drifts(spark, lam):
    v = np.random.default_rng(1).random(12_000 if lam == 0.94 else 900)
    rows = spark.createDataFrame(pd.DataFrame({"g": "a", "k": np.arange(1, len(v) + 1), "v": v}))
    got = decay.with_decayed_sum(rows, lam, F.col("v"), ["g"], "k", "s").orderBy("k").toPandas()["s"].to_numpy()
    want, s = [], 0.0
    for x in v:
        s = lam * s + x
        want.append(s)
    assert np.allclose(got, want, rtol=1e-9)


def _panel(spark, r):
    rows = [(t, i, None if i == 0 else float(v[i - 1])) for t, v in r.items() for i in range(len(v) + 1)]
    return spark.createDataFrame(rows, "ticker string, idx int, r double")


def test_filter_equals_recursion_and_fit_path(spark):
    rng = np.random.default_rng(4)
    r = {"A": rng.normal(0, 0.01, 150), "B": rng.normal(0, 0.02, 150)}
    last = spark.createDataFrame([(t, 150, 150) for t in r], "ticker string, idx int, of_idx int")
    values = (0.02, 0.05, 0.08, 0.8, 0.1, 7.0)
    params = last.select("ticker", "idx", *(F.lit(x).alias(k) for k, x in zip(volatility.PARAMS, values, strict=True)))
    got = volatility.filtered(_panel(spark, r), params, last, 120).orderBy("ticker", "day").toPandas()
    for t, v in r.items():
        x = v[-120:] * 100
        w = 0.94 ** np.arange(75)
        start = values[1] + (values[2] + values[3] + values[4] / 2) * float((w * (x[:75] - x.mean()) ** 2).sum() / w.sum())
        path = volatility.variance_path(x - values[0], *values[1:3], values[3], values[4], start)
        mine = got[got.ticker == t]
        assert np.allclose(mine["h"], path[:-1]) and np.allclose(mine["next_h"], path[1:])


def test_refit_then_filter(spark):
    rng = np.random.default_rng(4)
    panel = _panel(spark, {"A": rng.normal(0, 0.01, 180), "B": rng.normal(0, 0.01, 60)})
    panel = panel.withColumn("date", F.date_add(F.lit("2020-01-01"), F.col("idx")))
    days = spark.createDataFrame([("A", 150, 150), ("A", 170, 150), ("B", 50, 50), ("B", 55, 50)], "ticker string, idx int, of_idx int")
    with pytest.raises(Exception, match="50 returns; at least 100"):
        volatility.refit(panel, days.where("idx = of_idx"), 4).collect()
    fits = volatility.refit(panel, days.where("idx = of_idx"), 4, record_errors=True)
    assert {(r.ticker, r.fell_back, r.reason is None) for r in fits.collect()} == {("A", False, True), ("B", True, False)}
    got = {(r.ticker, r.idx): r for r in volatility.filter_vol(panel, fits, days, 4, 0.94).collect()}
    assert set(got) == {("A", 150), ("A", 170), ("B", 50), ("B", 55)}
    assert all(r.vol > 0 and r.fell_back == (r.ticker == "B") for r in got.values())


def test_projection():
    m = np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1]])
    p = correlation.projected(m)
    assert np.allclose(np.diag(p), 1) and np.allclose(p, p.T) and np.linalg.eigvalsh(p).min() > -1e-12
    assert np.allclose(correlation.projected(np.array([[4, 1], [1, 9.0]])), [[1, 1 / 6], [1 / 6, 1]])
    with pytest.raises(ValueError):
        correlation.projected(np.diag([1.0, 0.0]))


def _dcc_sample(a, b, n, seed):
    rng, mean = np.random.default_rng(seed), np.array([[1, 0.5, 0.3], [0.5, 1, 0.2], [0.3, 0.2, 1]])
    q, out = mean.copy(), np.empty((n, 3))
    for t in range(n):
        if t:
            q = (1 - a - b) * mean + a * np.outer(out[t - 1], out[t - 1]) + b * q
        d = np.sqrt(np.diag(q))
        out[t] = np.linalg.cholesky(q / np.outer(d, d)) @ rng.normal(size=3)
    return out


@pytest.mark.parametrize(("a", "b", "seed", "within"), [(0.05, 0.90, 42, (0.04, 0.06)), (0.03, 0.95, 7, (0.05, 0.08))])
def test_dcc_recovers_parameters(a, b, seed, within):
    e = _dcc_sample(a, b, 3000, seed)
    got = correlation.estimate_dcc(e, (0.01, 0.96), 0.0)
    assert abs(got[0] - a) < within[0] and abs(got[1] - b) < within[1] and not got[2]
    assert correlation.estimate_dcc(e[:1], (0.01, 0.96), 0.0) == (0.01, 0.96, True)


def test_dcc_closed_form_equals_the_recursion(spark):
    e = _dcc_sample(0.05, 0.9, 80, 3)
    rows = [(i, t, float(x)) for i, line in enumerate(e) for t, x in zip("abc", line, strict=True)]
    p = correlation.pairs(spark.createDataFrame(rows, "idx int, ticker string, e double"))
    got = {(r.ticker_i, r.ticker_j): r.corr for r in correlation.dcc_corr(p, 0.05, 0.9, 0.1).collect()}
    mean = 0.9 * np.corrcoef(e, rowvar=False) + 0.1 * np.eye(3)
    want = correlation.projected(correlation.dcc_path(e, 0.05, 0.9, mean)[-1])
    assert all(got[x, y] == pytest.approx(want[i, j]) for i, x in enumerate("abc") for j, y in enumerate("abc"))


def test_cadence_and_stale_residuals(spark):
    days = spark.createDataFrame([(i,) for i in (5, 10, 15, 20)], "epoch_idx int")
    assert [tuple(r) for r in correlation.cadence(days, 3).orderBy("epoch_idx").collect()] == [(5, 1, True, 5), (10, 2, False, 5), (15, 3, False, 5), (20, 4, True, 20)]
    resid = spark.createDataFrame([(1, "A", 0.5)], "idx int, ticker string, e double")
    assert correlation.fresh(resid, resid.select("idx", "ticker")).count() == 1
    with pytest.raises(Exception, match="stale"):
        correlation.fresh(resid, spark.createDataFrame([(2, "A")], "idx int, ticker string")).collect()


def test_band_modes_in_one_fold(spark):
    rows = [(m, "e", b, i, x) for m, b in (("absolute", 0.125), ("log", 0.5)) for i, x in enumerate((0.5, 0.625, 0.75, 1.0))]
    df = spark.createDataFrame(rows, "mode string, epoch string, band double, idx int, e double")
    got = {(r.mode, r.idx): (r.applied, r.blocked) for r in portfolio.banded(df, ["mode", "epoch", "band"], "idx", "e", F.col("band"), F.col("mode")).collect()}
    assert [got["absolute", i] for i in range(4)] == [(0.5, False), (0.5, True), (0.75, False), (1.0, False)]
    assert [got["log", i] for i in range(4)] == [(0.5, False), (0.5, True), (0.5, True), (1.0, False)]


def test_overlapping_decisions_are_an_error(spark):
    t = spark.createDataFrame([("s", 3, "A", 1.0), ("s", 3, "A", 0.5), ("s", 4, "A", 0.5)], "strategy_id string, exec_idx int, ticker string, weight double")
    assert [tuple(r) for r in backtest.overlapping(t).collect()] == [("s", 3)]


def test_normal_quantile_and_front_helpers(spark):
    from statistics import NormalDist

    p = [0.0001, 0.01, 0.3, 0.5, 0.9, 0.99999]
    got = [r.q for r in spark.createDataFrame([(x,) for x in p], "p double").select(stats.normal_quantile(F.col("p")).alias("q")).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(x) for x in p], abs=1e-7)
    front = spark.createDataFrame([(1.0, 1.0)], "x double, y double")
    worse, better = spark.createDataFrame([(2.0, 1.0)], "x double, y double"), spark.createDataFrame([(2.0, 1.0), (0.5, 3.0)], "x double, y double")
    assert stats.dominates(front, worse, "x", "y").first()[0] is True and stats.dominates(front, better, "x", "y").first()[0] is False
    a = spark.createDataFrame([("g", 1.0, "p"), ("g", 4.0, "q")], "of string, x double, name string")
    b = spark.createDataFrame([("g", 2.0, "r"), ("g", 4.5, "s")], "of string, x double, name string")
    best = stats.nearest_pair(a, b, "of", "x").first()
    assert (best.a.name, best.b.name, best.gap) == ("q", "s", 0.5)


def _simulated(rng, n, alpha, beta, gamma, nu):
    h, out = 1.0, []
    for _ in range(n):
        e = np.sqrt(h) * rng.standard_t(nu) * np.sqrt((nu - 2) / nu)
        out.append(e / 100)
        h = (1 - alpha - beta - gamma / 2) + (alpha + gamma * (e < 0)) * e * e + beta * h
    return np.array(out)


@pytest.mark.parametrize("asymmetric", [False, True])
def test_batched_search_finds_the_simplex_optimum(asymmetric):
    rng = np.random.default_rng(3)
    series = [_simulated(rng, n, 0.06, 0.88, 0.08 * asymmetric, 6) for n in (180, 400, 700, 401)] + [rng.normal(0, 0.01, 300)]
    together = likelihood.fit_garch_batch(series, asymmetric)
    for r, p in zip(series, together, strict=True):
        assert p == pytest.approx(likelihood.fit_garch_batch([r], asymmetric)[0], rel=1e-3, abs=1e-4)  # a batch is its series
        x, n = (r * 100)[:, None], np.array([len(r)])
        w = 0.94 ** np.arange(75)
        back = np.array([(w * (x[:75, 0] - x.mean()) ** 2).sum() / w.sum()])
        q0 = np.array([x.mean(), np.log(x.var() * 0.05), 3.0, 2.5, np.log(6.0), 0.0])[: 6 if asymmetric else 5]
        f = lambda q: float(likelihood.loss(q[None, :], x, n, back)[0][0])  # noqa: B023, E731
        best = volatility.minimise(f, q0, 4000, 1e-12)
        assert p["loglik"] >= -f(best) * len(r) - 1e-2
        g, eps = likelihood.loss(q0[None, :], x, n, back)[1][0], 1e-6
        assert g == pytest.approx([(f(q0 + eps * u) - f(q0 - eps * u)) / (2 * eps) for u in np.eye(len(q0))], abs=1e-6)


def test_batched_search_recovers_parameters():
    rng = np.random.default_rng(8)
    fits = likelihood.fit_garch_batch([_simulated(rng, 4000, 0.05, 0.88, 0.08, 7) for _ in range(4)], True)
    means = {k: np.mean([f[k] for f in fits]) for k in ("alpha", "beta", "gamma", "nu")}
    assert abs(means["alpha"] - 0.05) < 0.02 and abs(means["beta"] - 0.88) < 0.03 and abs(means["gamma"] - 0.08) < 0.04 and abs(means["nu"] - 7) < 1.5


def test_normal_distribution_function(spark):
    from statistics import NormalDist

    x = [-9.0, -7.2, -3.0, -1.0, -1e-9, 0.0, 0.3, 1.0, 2.5, 7.05, 8.0]
    got = [r.p for r in spark.createDataFrame([(v,) for v in x], "x double").select(stats.normal_cdf(F.col("x")).alias("p")).collect()]
    assert got == pytest.approx([NormalDist().cdf(v) for v in x], abs=1e-14)


def test_correlations_use_shared_days_and_the_past_only(spark):
    rng = np.random.default_rng(2)
    days = {"A": range(1, 60), "B": [i for i in range(1, 60) if i % 7], "C": [i for i in range(1, 60) if i % 5]}
    rows = [(t, i, float(rng.normal(0, 0.01))) for t, own in days.items() for i in own]
    panel = spark.createDataFrame(rows, "ticker string, idx int, r double")
    at = spark.createDataFrame([(41, t) for t in days], "idx int, ticker string")
    got = {}
    for cut in (41, 59):
        resid = volatility.residuals_at(panel.where(F.col("idx") <= cut), at, 0.94)
        got[cut] = {(r.ticker_i, r.ticker_j): r.corr for r in correlation.corr_at(resid, at, 0.94).collect()}
    assert got[41] == pytest.approx(got[59]) and len(got[41]) == 9
    e = {}
    for t, own in days.items():
        r = [v for tt, i, v in rows if tt == t and i <= 41]
        h, out = np.var(r, ddof=1), []
        for v in r:
            out.append(v / np.sqrt(h))
            h = 0.94 * h + 0.06 * v * v
        e[t] = dict(zip([i for i in own if i <= 41], out, strict=True))
    shared = sorted(set.intersection(*(set(x) for x in e.values())))
    m = np.array([[e[t][i] for t in days] for i in shared])
    s = np.cov(m, rowvar=False)
    for row in m[:-1]:
        s = 0.94 * s + 0.06 * np.outer(row, row)
    want = s / np.sqrt(np.outer(np.diag(s), np.diag(s)))
    assert [got[41][a, b] for a in days for b in days] == pytest.approx(want.ravel())
    a, b, c = 0.02, 0.95, 0.9 * np.corrcoef(m, rowvar=False) + 0.1 * np.eye(3)
    q = c
    for row in m[:-1]:
        q = (1 - a - b) * c + a * np.outer(row, row) + b * q
    dcc = {(r.ticker_i, r.ticker_j): r.corr for r in correlation.corr_at(volatility.residuals_at(panel, at, 0.94), at, 0.94, (a, b)).collect()}
    assert [dcc[x, y] for x in days for y in days] == pytest.approx((q / np.sqrt(np.outer(np.diag(q), np.diag(q)))).ravel())
