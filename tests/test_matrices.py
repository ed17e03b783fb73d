"""Folds over small matrices and what stands on them, against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import correlation, matrices


def _long(spark, given: dict[int, np.ndarray]):
    rows = [(g, f"t{i}", f"t{j}", float(m[i, j])) for g, m in given.items() for i in range(len(m)) for j in range(len(m))]
    return spark.createDataFrame(rows, "g int, ticker_i string, ticker_j string, corr double")


def _some(n: int) -> dict[int, np.ndarray]:
    rng, out = np.random.default_rng(5), {}
    for g in range(n):
        m = rng.uniform(-1, 1, (1 + g % 6,) * 2)
        out[g] = (m + m.T) / 2
        np.fill_diagonal(out[g], 1.0)
    return out


def test_projection_and_spectrum_of_indefinite_matrices(spark):
    given = _some(18) | {90: np.eye(3), 91: np.ones((4, 4)), 92: np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1]]), 93: np.array([[4, 1], [1, 9.0]])}
    assert any(np.linalg.eigvalsh(m)[0] < -0.1 for m in given.values())
    df = _long(spark, given)
    got = {(r.g, r.ticker_i, r.ticker_j): r.corr for r in correlation.project(df, "g").collect()}
    values = {(r.g, r.place): r.eigenvalue for r in correlation.spectrum(df, "g").collect()}
    for g, m in given.items():
        assert np.allclose([[got[g, f"t{i}", f"t{j}"] for j in range(len(m))] for i in range(len(m))], correlation.projected(m), atol=1e-12)
        assert np.allclose([values[g, i + 1] for i in range(len(m))], np.linalg.eigvalsh(m), atol=1e-12)


def test_halves_that_differ_are_mirrored(spark):
    got = {(r.ticker_i, r.ticker_j): r.corr for r in correlation.project(_long(spark, {0: np.array([[1, 0.6], [0.2, 1]])}), "g").collect()}
    assert got["t0", "t1"] == pytest.approx(0.4) and got["t1", "t0"] == pytest.approx(0.4)


def test_matrices_without_a_result_are_errors(spark):
    with pytest.raises(Exception, match="collapsed"):
        correlation.project(_long(spark, {0: np.diag([1.0, 0.0])}), "g").collect()
    for odd in (_long(spark, {0: np.eye(2)}).where("ticker_i = 't0' or ticker_j = 't1'"), _long(spark, {0: np.array([[1, np.nan], [0, 1]])})):
        with pytest.raises(Exception, match="places missing"):
            correlation.project(odd, "g").collect()
    assert correlation.project(_long(spark, {0: np.eye(2)}).limit(0), "g").count() == 0


def test_loss_by_elimination(spark):
    rng, rows, want = np.random.default_rng(1), [], []
    for k in (1, 2, 5):
        a = rng.normal(size=(k, k + 3))
        m, e = a @ a.T, rng.normal(size=k)
        rows.append((k, m.ravel().tolist(), e.tolist()))
        want.append(np.linalg.slogdet(m)[1] + e @ np.linalg.solve(m, e))
    rows.append((2, [1.0, 2.0, 2.0, 1.0], [1.0, 1.0]))
    df = spark.createDataFrame(rows, "k int, m array<double>, e array<double>")
    got = [r.loss for r in df.select(matrices.quasi_loss(F.col("m"), F.col("e"), F.col("k")).alias("loss")).collect()]
    assert got[:3] == pytest.approx(want) and got[3] == float("inf")


def test_pairs_count_their_own_days(spark):
    rng = np.random.default_rng(2)
    rows = [(t, d, float(rng.normal())) for t in "abc" for d in range(60) if (d + ord(t)) % 3]
    values = spark.createDataFrame(rows, "ticker string, idx int, x double")
    at = spark.createDataFrame([(d, t) for d in (9, 31, 50) for t in "abc"] + [(50, "never")], "idx int, ticker string")
    have, found = {(t, d): x for t, d, x in rows}, 0
    for r in correlation.pairwise_corr(values, at, 10, 4).collect():
        days = [d for d in range(r.idx - 9, r.idx + 1) if (r.ticker_i, d) in have and (r.ticker_j, d) in have]
        assert r.n_days == len(days)
        if r.ticker_i == r.ticker_j:
            assert r.corr == 1.0
        elif len(days) < 4:
            assert r.corr == 0.0
        else:
            found += 1
            assert r.corr == pytest.approx(np.corrcoef([have[r.ticker_i, d] for d in days], [have[r.ticker_j, d] for d in days])[0, 1])
    assert found


def test_profile_is_the_loss_of_each_cell_and_agrees_with_the_search(spark):
    rng, mean, q = np.random.default_rng(11), np.array([[1, 0.5, 0.3], [0.5, 1, 0.2], [0.3, 0.2, 1]]), None
    e = np.empty((900, 3))
    for t in range(len(e)):
        q = mean if q is None else 0.07 * mean + 0.05 * np.outer(e[t - 1], e[t - 1]) + 0.88 * q
        d = np.sqrt(np.diag(q))
        e[t] = np.linalg.cholesky(q / np.outer(d, d)) @ rng.normal(size=3)
    rows = [(0, t, k, float(x)) for t, line in enumerate(e) for k, x in zip("abc", line, strict=True)]
    resid = spark.createDataFrame([*rows, (0, 5000, "a", 9.0)], "idx int, day int, ticker string, e double")  # a day that a has alone
    steps_a, steps_b = [0.01, 0.03, 0.05, 0.07], [0.80, 0.84, 0.88, 0.92]
    got = correlation.dcc_profile(resid, resid.select("idx", "ticker").distinct(), [(a, b) for a in steps_a for b in steps_b], 0.1).collect()
    target = 0.9 * np.corrcoef(e, rowvar=False) + 0.1 * np.eye(3)
    assert len(got) == 16 and all(r.n_days == 900 and r.loss == pytest.approx(correlation.dcc_loss(e, r.a, r.b, target)) for r in got)
    best = next(r for r in got if r.place == 1)
    a, b, fell = correlation.estimate_dcc(e, (0.01, 0.96), 0.1)
    assert not fell and abs(a - best.a) <= 0.02 and abs(b - best.b) <= 0.04
    with pytest.raises(ValueError, match="out of range"):
        correlation.dcc_profile(resid, resid.select("idx", "ticker"), [(0.1, 0.95)], 0.1)
