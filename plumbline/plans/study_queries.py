"""Queries of experiments, significance and the read layer, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators import backtest, correlation, matrices, metrics, signals, stats, volatility
from plumbline.plans import oracle, readers
from plumbline.plans.oracle import C, METRICS, book_sql, sql
from plumbline.plans.queries import _BASE, _EWC, _FIVE, _FOUR, _KEYS, _PAIRS, _SUBPERIODS, _UNIT, _last_pairs, _spans, _PBO, _moments_sql, _psr_sql, _returns, _returns_of, query, r6, s6
from plumbline.plans.strategies import Study, grid_book, grid_targets, look_ahead
from plumbline.sources import market
from plumbline.sources.tables import cut, new_path

# ---- models with parameters given, cadence, projection

#: Fixed parameters of the filter query.
MU, OMEGA, ALPHA, BETA, GAMMA = 0.0, 0.05, 0.05, 0.85, 0.06

_GARCH = f"""gk AS (SELECT ticker, idx, k, r * 100 - {MU} AS e, r * 100 AS x FROM ret),
g0 AS (SELECT ticker, {OMEGA} + {ALPHA + BETA + GAMMA / 2} * sum(pow(0.94, k - 1) * pow(x - m, 2)) / sum(pow(0.94, k - 1)) AS h FROM (SELECT *, avg(x) OVER (PARTITION BY ticker) AS m FROM gk) WHERE k <= 75 GROUP BY 1),
gf AS (SELECT g.ticker, g.idx, g.k, g.e, g0.h, {OMEGA} + ({ALPHA} + CASE WHEN g.e < 0 THEN {GAMMA} ELSE 0 END) * g.e * g.e + {BETA} * g0.h AS next_h FROM gk g JOIN g0 USING (ticker) WHERE k = 1
  UNION ALL SELECT g.ticker, g.idx, g.k, g.e, f.next_h, {OMEGA} + ({ALPHA} + CASE WHEN g.e < 0 THEN {GAMMA} ELSE 0 END) * g.e * g.e + {BETA} * f.next_h FROM gf f JOIN gk g ON g.ticker = f.ticker AND g.k = f.k + 1)"""


def _filtered(s: Study) -> DataFrame:
    last = s.panel.where(F.col("idx") == s.last_idx).select("ticker", F.col("idx").cast("int").alias("idx"), F.col("idx").cast("int").alias("of_idx"))
    values = {"mu": MU, "omega": OMEGA, "alpha": ALPHA, "beta": BETA, "gamma": GAMMA, "nu": 8.0}
    params = last.select("ticker", "idx", *(F.lit(v).alias(k) for k, v in values.items()))
    return volatility.filtered(s.panel, params, last)


@query("garch_filter", sql(f"SELECT ticker, idx AS day, {s6('h')}, {s6('next_h')}, {s6('e / sqrt(h)', 'std_resid')} FROM gf", ["ret"], _GARCH))
def _(spark, d):
    return _filtered(Study(spark, d)).select("ticker", "day", r6("h"), r6("next_h"), r6(F.col("e") / F.sqrt("h"), "std_resid"))


_P = ALPHA + BETA + GAMMA / 2
_LEVEL = OMEGA / (1 - _P)


@query("garch_forecast", sql(f"SELECT ticker, {s6(f'sqrt(({_LEVEL} + (next_h - {_LEVEL}) * (1 - pow({_P}, {C.horizon})) / ((1 - {_P}) * {C.horizon})) / 1e4) * sqrt(252)', 'vol')}, {_P} < 1 AS stationary FROM (SELECT ticker, arg_max(next_h, k) AS next_h FROM gf GROUP BY 1)", ["ret"], _GARCH))
def _(spark, d):
    last = _filtered(Study(spark, d)).groupBy("ticker").agg(*(F.max_by(c, "day").alias(c) for c in ("next_h", "omega", "alpha", "beta", "gamma")))
    stationary = F.col("alpha") + F.col("beta") + F.col("gamma") / 2 < 1
    return last.select("ticker", r6(volatility.forecast("next_h", C.horizon), "vol"), stationary.alias("stationary"))


@query("spec_comparison")
def _(spark, d):
    """Forecasts of each model at the last four selections against what followed; a failed cell has its reason."""
    s = Study(spark, d)
    days = s.clock.where("is_selection").where(F.col("idx") + C.horizon <= s.last_idx).orderBy(F.desc("idx")).limit(4).select("idx")
    asked = cut(s.panel.join(F.broadcast(days), "idx").select("ticker", "idx", F.col("idx").alias("of_idx")), "asked")
    fits = cut(volatility.refit(s.panel, asked, C.horizon, record_errors=True), "fits")
    garch = volatility.filter_vol(s.panel, fits, asked, C.horizon, C.lam).select("ticker", "idx", F.lit("garch").alias("spec"), "vol")
    plain = s.vol.join(asked.select("ticker", "idx"), ["ticker", "idx"]).select("ticker", "idx", F.lit("ewma").alias("spec"), "vol")
    ahead = Window.partitionBy("ticker").orderBy("idx").rowsBetween(1, C.horizon)
    after = s.panel.withColumn("realized", F.avg(F.col("r") * F.col("r")).over(ahead)).select("ticker", "idx", "realized")
    rows = garch.unionByName(plain).join(after, ["ticker", "idx"]).withColumn("forecast", F.col("vol") * F.col("vol") / 252).where("realized > 0")
    out = rows.groupBy("ticker", "spec").agg(F.count(F.lit(1)).alias("n_points"), r6(volatility.qlike("realized", "forecast"), "qlike"))
    why = fits.groupBy("ticker").agg(F.max("reason").alias("reason"))
    return out.join(why, "ticker").select("ticker", "spec", "n_points", "qlike", F.when(F.col("spec") == "garch", F.col("reason")).alias("reason"))


@query("sample_corr", sql(f"SELECT ticker_i, ticker_j, {s6('corr(x, y)', 'corr')} FROM pr GROUP BY 1, 2", _BASE, f"{_FIVE},{_PAIRS}"))
def _(spark, d):
    return correlation.sample_corr(_last_pairs(Study(spark, d))).select("ticker_i", "ticker_j", r6("corr"))


@query("portfolio_vol", sql(f"SELECT {s6('sqrt(greatest(sum(0.2 * a.vol * corr * b.vol * 0.2), 0))', 'sigma_p')} FROM cr JOIN vol a ON a.ticker = ticker_i AND a.idx = (SELECT max(idx) FROM vol) JOIN vol b ON b.ticker = ticker_j AND b.idx = a.idx", [*_BASE, "vol"], f"{_FIVE},{_PAIRS},{_EWC},{_UNIT}"))
def _(spark, d):
    s = Study(spark, d)
    cov = cut(correlation.covariance(correlation.ewma_corr(_last_pairs(s), C.lam), s.vol.where(F.col("idx") == s.last_idx)), "cov", 1)
    return correlation.portfolio_vol(cov, cov.select(F.col("ticker_i").alias("ticker"), F.lit(0.2).alias("weight")).distinct()).select(r6("sigma_p"))


@query("residual_panel", sql(f"SELECT s.idx, s.ticker, {s6('e')} FROM sel s JOIN r_ivol r ON r.ticker = s.ticker AND r.dt = s.idx AND r.idx = s.idx", ["sel", "r_ivol"]))
def _(spark, d):
    s = Study(spark, d)
    now = s.residuals(s.selection.select("idx", "ticker")).where("day = idx")
    return correlation.fresh(now, s.selection.select("idx", "ticker")).select("idx", "ticker", r6("e"))


#: Weeks of a matrix with gaps, and the fewest that tell a correlation.
GAP_WINDOW, GAP_DAYS = 16, 3

_GAPS = f"""act AS (SELECT r.ticker, r.idx, r.r AS x FROM ret r JOIN days USING (idx) JOIN (SELECT ticker, date, volume * count(*) OVER w >= sum(volume) OVER w AS active FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)) v ON v.ticker = r.ticker AND v.date = days.date WHERE active),
gw AS (SELECT s.idx, s.ticker, a.idx AS day, a.x FROM sel s JOIN act a ON a.ticker = s.ticker AND a.idx <= s.idx AND a.idx > s.idx - {GAP_WINDOW}),
gp AS (SELECT x.idx, x.ticker AS ticker_i, y.ticker AS ticker_j, count(*) AS n, CASE WHEN count(*) >= {GAP_DAYS} AND var_samp(x.x) > 0 AND var_samp(y.x) > 0 THEN corr(x.x, y.x) END AS c FROM gw x JOIN gw y ON y.idx = x.idx AND y.day = x.day GROUP BY 1, 2, 3),
gc AS (SELECT a.idx, a.ticker AS ticker_i, b.ticker AS ticker_j, coalesce(n, 0) AS n_days, CASE WHEN a.ticker = b.ticker THEN 1.0 ELSE coalesce(c, 0) END AS corr FROM sel a JOIN sel b ON b.idx = a.idx LEFT JOIN gp ON gp.idx = a.idx AND ticker_i = a.ticker AND ticker_j = b.ticker),
gm AS (SELECT idx, sqrt(count(*))::BIGINT AS k, list(corr ORDER BY ticker_i, ticker_j) AS a, list(CASE WHEN ticker_i = ticker_j THEN 1.0 ELSE 0.0 END ORDER BY ticker_i, ticker_j) AS v, list(DISTINCT ticker_i ORDER BY ticker_i) AS tick FROM gc GROUP BY 1),
gq AS (SELECT k, list([p, q] ORDER BY p, q) AS pq FROM (SELECT DISTINCT k FROM gm), range(50) x(p), range(50) y(q) WHERE p < q AND q < k GROUP BY 1),
js AS (SELECT idx, 0::BIGINT AS n, k, pq, tick, a::DOUBLE[] AS a, v::DOUBLE[] AS v FROM gm JOIN gq USING (k) UNION ALL
  SELECT idx, n + 1, k, pq, tick, list_transform(b, lambda x, m: CASE WHEN (m - 1) // k = p THEN c * x - s * b[m + (q - p) * k] WHEN (m - 1) // k = q THEN s * b[m - (q - p) * k] + c * x ELSE x END), v
  FROM (SELECT *, list_transform(a, lambda x, m: CASE WHEN (m - 1) % k = p THEN c * x - s * a[m + q - p] WHEN (m - 1) % k = q THEN s * a[m - q + p] + c * x ELSE x END) AS b, list_transform(w, lambda x, m: CASE WHEN (m - 1) % k = p THEN c * x - s * w[m + q - p] WHEN (m - 1) % k = q THEN s * w[m - q + p] + c * x ELSE x END) AS v
  FROM (SELECT *, 1 / sqrt(t * t + 1) AS c, t / sqrt(t * t + 1) AS s FROM (SELECT *, CASE WHEN abs(o) < 1e-300 THEN 0.0 ELSE (CASE WHEN h >= 0 THEN 1.0 ELSE -1.0 END) / (abs(h) + sqrt(h * h + 1)) END AS t
  FROM (SELECT *, (a[q * k + q + 1] - a[p * k + p + 1]) / (2 * o) AS h FROM (SELECT *, a[p * k + q + 1] AS o FROM (SELECT idx, n, k, pq, tick, a, v AS w, pq[n % len(pq) + 1][1] AS p, pq[n % len(pq) + 1][2] AS q FROM js WHERE n < {matrices.SWEEPS} * len(pq)))))))),
je AS (SELECT * FROM js WHERE n = {matrices.SWEEPS} * len(pq))"""


def _gapped(s: Study, d: str) -> DataFrame:
    """Correlations of each selection's tickers over its last weeks, where weeks that trade less than the ticker's average so
    far are gaps; pairs share few weeks, so most of the matrices are indefinite."""
    so_far = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    b = market.bars(s.spark, d).select("ticker", "date", (F.col("volume") * F.count(F.lit(1)).over(so_far) >= F.sum("volume").over(so_far)).alias("active"))
    rows = s.panel.where("r is not null").join(b.where("active"), ["ticker", "date"]).select("ticker", "idx", F.col("r").alias("x"))
    return cut(correlation.pairwise_corr(rows, s.selection.select("idx", "ticker"), GAP_WINDOW, GAP_DAYS), "gapped")


@query("corr_pairwise", sql(f"SELECT idx, ticker_i, ticker_j, n_days, {s6('corr')} FROM gc", ["sel", "ret", "days", "bars"], _GAPS))
def _(spark, d):
    return _gapped(Study(spark, d), d).select("idx", "ticker_i", "ticker_j", "n_days", r6("corr"))


@query("corr_spectrum", sql(f"SELECT idx, row_number() OVER (PARTITION BY idx ORDER BY e) AS place, {s6('e', 'eigenvalue')} FROM (SELECT idx, unnest(list_transform(range(k), lambda i: a[i * k + i + 1])) AS e FROM je)", ["sel", "ret", "days", "bars"], _GAPS))
def _(spark, d):
    """Eigenvalues of every selection's matrix with gaps."""
    return correlation.spectrum(_gapped(Study(spark, d), d), "idx").select("idx", "place", r6("eigenvalue"))


@query("corr_projection", sql(f"""SELECT idx, tick[i + 1] AS ticker_i, tick[j + 1] AS ticker_j, {s6('CASE WHEN i = j THEN 1.0 ELSE f[i * k + j + 1] / sqrt(f[i * k + i + 1] * f[j * k + j + 1]) END', 'corr')}
FROM (SELECT *, unnest(range(k * k)) // k AS i, unnest(range(k * k)) % k AS j FROM (SELECT idx, k, tick, list_transform(range(k * k), lambda n: list_sum(list_transform(range(k), lambda c: greatest(a[c * k + c + 1], 0) * v[(n // k) * k + c + 1] * v[(n % k) * k + c + 1]))) AS f FROM je))""", ["sel", "ret", "days", "bars"], _GAPS))
def _(spark, d):
    """Every selection's matrix with gaps, made a correlation matrix."""
    return correlation.project(_gapped(Study(spark, d), d), "idx").select("idx", "ticker_i", "ticker_j", r6("corr"))


_SEEN = ("bh_market", "ew_menu", "sixty_forty", "mom_only", "mom_ivol", "voltarget_only", "full", "full_erc", "full_garch_dcc")
_UNTIL = f"{oracle.WARM} + (SELECT max(idx) - {oracle.WARM} FROM days) // 2"


@query("no_look_ahead", sql("SELECT strategy_id, count(*) AS compared, 0::BIGINT AS differing FROM (" + " UNION ALL ".join(f"SELECT strategy_id, decision_idx FROM t_{n}" for n in _SEEN) + f") WHERE decision_idx <= {_UNTIL} GROUP BY 1", ["days", *(f"t_{n}" for n in _SEEN)]))
def _(spark, d):
    """Targets up to a day do not change when the days after it are cut off."""
    return look_ahead(spark, d, _SEEN)


@query("dcc_cadence", sql("SELECT epoch_idx, number, (number - 1) % 3 = 0 AS estimated, max(CASE WHEN (number - 1) % 3 = 0 THEN epoch_idx END) OVER (ORDER BY epoch_idx ROWS UNBOUNDED PRECEDING) AS of_idx FROM (SELECT idx AS epoch_idx, row_number() OVER (ORDER BY idx) AS number FROM clock WHERE is_selection)", ["clock"]))
def _(spark, d):
    return correlation.cadence(Study(spark, d).clock.where("is_selection").select(F.col("idx").alias("epoch_idx")), 3)


@query("dcc_estimates")
def _(spark, d):
    """(a, b) by quasi likelihood at every third selection, from the residuals of the tickers selected then."""
    s = Study(spark, d)
    days = correlation.cadence(s.clock.where("is_selection").select(F.col("idx").alias("epoch_idx")), 3).where("estimated").select("epoch_idx")
    chosen = s.selection.select(F.col("idx").alias("epoch_idx"), "ticker").join(F.broadcast(days), "epoch_idx")
    rows = s.residuals(chosen.select(F.col("epoch_idx").alias("idx"), "ticker")).select(F.col("idx").alias("epoch_idx"), F.col("day").alias("idx"), "ticker", "e")
    return correlation.dcc_params(rows.repartition("epoch_idx"), "epoch_idx", (0.01, 0.96), 0.1).select("epoch_idx", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"), "fell_back")


#: Cells of the profile of (a, b); sums that reach the bound are left out.
PROFILE = [(a, b) for a in (0.01, 0.02, 0.04, 0.06) for b in (0.85, 0.9, 0.93, 0.96) if a + b < correlation.BOUND - 1e-9]

_PROFILE = f"""pd AS (SELECT epoch_idx AS dt FROM (SELECT idx AS epoch_idx, row_number() OVER (ORDER BY idx) AS number FROM clock WHERE is_selection) WHERE (number - 1) % 3 = 0),
pe AS (SELECT dt, k, max(n) AS n, list(e ORDER BY ticker) AS e FROM x_ivol JOIN pd USING (dt) GROUP BY 1, 2),
pm AS (SELECT dt, list(q ORDER BY ti, tj) AS mean FROM (SELECT x.dt, x.ticker AS ti, y.ticker AS tj, 0.9 * corr(x.e, y.e) + CASE WHEN x.ticker = y.ticker THEN 0.1 ELSE 0 END AS q FROM x_ivol x JOIN x_ivol y ON y.dt = x.dt AND y.idx = x.idx JOIN pd ON pd.dt = x.dt GROUP BY 1, 2, 3) GROUP BY 1),
pg AS (SELECT * FROM (VALUES {", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in PROFILE)}) v(a, b)),
pq AS (SELECT dt, a, b, 1::BIGINT AS k, mean AS q FROM pm, pg UNION ALL
  SELECT p.dt, p.a, p.b, p.k + 1, list_transform(p.q, lambda x, i: p.b * x + (1 - p.a - p.b) * mean[i] + p.a * e.e[(i - 1) // len(e.e) + 1] * e.e[(i - 1) % len(e.e) + 1]) FROM pq p JOIN pe e ON e.dt = p.dt AND e.k = p.k AND p.k < e.n JOIN pm ON pm.dt = p.dt),
pr AS (SELECT dt, a, b, k, n, e, len(e) AS s, list_transform(q, lambda x, i: x / sqrt(q[((i - 1) // len(e)) * len(e) + (i - 1) // len(e) + 1] * q[((i - 1) % len(e)) * len(e) + (i - 1) % len(e) + 1])) AS r FROM pq JOIN pe USING (dt, k)),
pl AS (SELECT dt, a, b, k, n, s, 0::BIGINT AS i, r, e, 0.0::DOUBLE AS loss FROM pr UNION ALL
  SELECT dt, a, b, k, n, s, i + 1, list_transform(r, lambda x, m: CASE WHEN (m - 1) // s > i THEN x - r[((m - 1) // s) * s + i + 1] / r[i * s + i + 1] * r[i * s + (m - 1) % s + 1] ELSE x END),
  list_transform(e, lambda x, m: CASE WHEN m - 1 > i THEN x - r[(m - 1) * s + i + 1] / r[i * s + i + 1] * e[i + 1] ELSE x END), loss + ln(r[i * s + i + 1]) + e[i + 1] * e[i + 1] / r[i * s + i + 1] FROM pl WHERE i < s),
pf AS (SELECT dt AS epoch_idx, a, b, max(n) AS n_days, sum(loss) AS loss FROM pl WHERE i = s GROUP BY 1, 2, 3)"""


@query("dcc_profile", sql(f"SELECT epoch_idx, a, b, n_days, {s6('loss')}, row_number() OVER (PARTITION BY epoch_idx ORDER BY loss, a, b) AS place FROM pf", ["clock", "x_ivol"], _PROFILE))
def _(spark, d):
    """The quasi likelihood over a grid of (a, b) at every third selection."""
    s = Study(spark, d)
    days = correlation.cadence(s.clock.where("is_selection").select(F.col("idx").alias("epoch_idx")), 3).where("estimated").select(F.col("epoch_idx").alias("idx"))
    chosen = cut(s.selection.select("idx", "ticker").join(F.broadcast(days), "idx"), "chosen")
    out = correlation.dcc_profile(s.residuals(chosen), chosen, PROFILE, 0.1)
    return out.select(F.col("idx").alias("epoch_idx"), "a", "b", "n_days", r6("loss"), "place")


_LOGFOLD = f"""fl AS (SELECT epoch_idx, idx, n, e, e AS applied, FALSE AS blocked FROM n_sig_ivol WHERE n = 1 UNION ALL
  SELECT b.epoch_idx, b.idx, b.n, b.e, CASE WHEN abs(ln(b.e) - ln(f.applied)) > {C.band} THEN b.e ELSE f.applied END, NOT abs(ln(b.e) - ln(f.applied)) > {C.band} FROM fl f JOIN n_sig_ivol b ON b.epoch_idx = f.epoch_idx AND b.n = f.n + 1)"""


@query("exposure_band_log", sql(f"SELECT epoch_idx, idx, {s6('e', 'exposure')}, {s6('applied')}, blocked FROM fl", ["n_sig_ivol"], _LOGFOLD))
def _(spark, d):
    s = Study(spark, d, signals.Config(band_mode="log"))
    return s.exposures(s._risky().withColumnRenamed("decision_idx", "epoch_idx")).select("epoch_idx", "idx", r6("exposure"), r6("applied"), "blocked")


# ---- parameter grid

#: One setting moved at a time, and the band under both modes.
CELLS = [("baseline", 0.10, 0.10, "absolute"), ("risk.sigma_star=0.08", 0.08, 0.10, "absolute"), ("risk.sigma_star=0.12", 0.12, 0.10, "absolute")]
CELLS += [(f"{mode}:risk.exposure_band={band}", 0.10, band, mode) for mode, bands in (("absolute", (0.01, 0.03, 0.06)), ("log", (0.05, 0.1, 0.2))) for band in bands]

oracle.CTES |= {
    "cells": ([], "SELECT * FROM (VALUES " + ", ".join(f"('{c}', {a}, {b}, '{m}')" for c, a, b, m in CELLS) + ") v(cell, sigma_star, band, band_mode)"),
    "n_grid": (["sig_one", "cells"], f"SELECT *, row_number() OVER (PARTITION BY cell, epoch_idx ORDER BY idx) AS n, least(greatest(sigma_star / sigma_p, {C.e_min}), 1.0) AS e FROM sig_one CROSS JOIN cells"),
    "f_grid": (["n_grid"], """SELECT cell, epoch_idx, idx, exec_idx, n, e, e AS applied, FALSE AS blocked FROM n_grid WHERE n = 1
  UNION ALL SELECT b.cell, b.epoch_idx, b.idx, b.exec_idx, b.n, b.e, CASE WHEN g.gap > b.band THEN b.e ELSE f.applied END, NOT g.gap > b.band
  FROM f_grid f JOIN n_grid b ON b.cell = f.cell AND b.epoch_idx = f.epoch_idx AND b.n = f.n + 1, LATERAL (SELECT CASE WHEN b.band_mode = 'log' THEN abs(ln(b.e) - ln(f.applied)) ELSE abs(b.e - f.applied) END AS gap) g"""),
    "t_cells": (["f_grid"], f"""SELECT cell AS strategy_id, idx AS decision_idx, exec_idx, '{C.market}' AS ticker, applied AS weight FROM f_grid WHERE NOT blocked
  UNION ALL SELECT cell, idx, exec_idx, 'CASH', 1 - applied FROM f_grid WHERE NOT blocked"""),
}
_METRICS_RAW = f"SELECT strategy_id, n_days, {', '.join(_KEYS)} FROM (SELECT strategy_id, {METRICS} FROM dd JOIN rf USING (idx) GROUP BY 1) LEFT JOIN ex USING (strategy_id)"
_METRICS_SQL = f"SELECT strategy_id, n_days, {', '.join(s6(k) for k in _KEYS)} FROM (SELECT strategy_id, {METRICS} FROM dd JOIN rf USING (idx) GROUP BY 1) LEFT JOIN ex USING (strategy_id)"


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the volatility target under every cell."""
    b, s = _cell_book(spark, d)
    return metrics.bundle(b.nav, s.rf, b.weights)


_CELL = "cell string, sigma_star double, band double, band_mode string"


def _cell_book(spark: SparkSession, d: str) -> tuple[backtest.Book, Study]:
    """All cells are one book, told apart by strategy_id."""
    s = Study(spark, d)
    return grid_book(s, "voltarget_only", spark.createDataFrame(CELLS, _CELL))[1], s


#: Cells that cannot run, beside those that can.
MIXED = [CELLS[0], ("risk.sigma_star=-0.1", -0.1, 0.1, "absolute"), CELLS[1], ("risk.exposure_band_mode=cubic", 0.1, 0.1, "cubic")]
_REASON = """CASE WHEN NOT coalesce(sigma_star > 0, FALSE) THEN 'risk.sigma_star must be positive' WHEN NOT coalesce(band >= 0, FALSE) THEN 'risk.exposure_band must not be negative'
  WHEN NOT coalesce(band_mode IN ('absolute', 'log'), FALSE) THEN 'unknown risk.exposure_band_mode: ' || coalesce(band_mode, 'null') END"""


@query("ablation_errors", book_sql(f"""SELECT v.cell, v.reason IS NULL AS ok, v.reason, {s6('m.sharpe', 'sharpe')}, {s6('m.ann_vol', 'ann_vol')} FROM (SELECT cell, {_REASON} AS reason FROM (VALUES {', '.join(f"('{c}', {a}, {b}, '{m}')" for c, a, b, m in MIXED)}) x(cell, sigma_star, band, band_mode)) v
  LEFT JOIN ({_METRICS_RAW}) m ON m.strategy_id = v.cell AND v.reason IS NULL""", ["cells"]))
def _(spark, d):
    """A grid with two cells that cannot run: they are rows with a reason, the others have their metrics."""
    s = Study(spark, d)
    judged, b = grid_book(s, "voltarget_only", spark.createDataFrame(MIXED, _CELL))
    out = judged.join(metrics.bundle(b.nav, s.rf, b.weights).withColumnRenamed("strategy_id", "cell"), "cell", "left")
    return out.select("cell", F.col("reason").isNull().alias("ok"), "reason", r6("sharpe"), r6("ann_vol"))


@query("ablation_metrics", book_sql(_METRICS_SQL, ["cells"]))
def _(spark, d):
    return _cells(spark, d).select("strategy_id", "n_days", *(r6(k) for k in _KEYS))


_SHOWN = ("baseline", "risk.sigma_star=0.08", "risk.sigma_star=0.12")


@query("ablation_pivot", book_sql(f"SELECT 'sharpe' AS metric, {', '.join(s6(f'''max(CASE WHEN strategy_id = '{c}' THEN sharpe END)''', chr(34) + c + chr(34)) for c in _SHOWN)} FROM ({_METRICS_SQL})", ["cells"]))
def _(spark, d):
    rows = _cells(spark, d).select(F.lit("sharpe").alias("metric"), "strategy_id", "sharpe")
    out = rows.groupBy("metric").pivot("strategy_id", list(_SHOWN)).agg(F.avg("sharpe"))
    return out.select("metric", *(r6(F.col(f"`{c}`"), c) for c in _SHOWN))


@query("cell_sharpe_variance", book_sql(f"SELECT {s6('var_samp(sharpe)', 'variance')}, count(sharpe) AS cells FROM ({_METRICS_RAW})", ["cells"]))
def _(spark, d):
    return _cells(spark, d).agg(r6(F.var_samp("sharpe"), "variance"), F.count("sharpe").alias("cells"))


def _frontier(spark: SparkSession, d: str) -> DataFrame:
    return cut(readers.frontier(_cells(spark, d), C.sigma_star), "frontier", 1)


_FRONT = f"fr AS (SELECT split_part(strategy_id, ':', 1) AS mode, CAST(split_part(strategy_id, '=', 2) AS DOUBLE) AS band, turnover, abs(ann_vol - {C.sigma_star}) AS tracking_error, sharpe FROM ({_METRICS_RAW}) WHERE strategy_id LIKE '%:risk.exposure_band=%')"


def _front_sql(body: str) -> str:
    return book_sql(f"SELECT * FROM (WITH {_FRONT} {body})", ["cells"])


@query("frontier", _front_sql(f"SELECT mode, band, {s6('turnover')}, {s6('tracking_error')}, {s6('sharpe')} FROM fr"))
def _(spark, d):
    return _frontier(spark, d).select("mode", "band", r6("turnover"), r6("tracking_error"), r6("sharpe"))


@query("frontier_front", _front_sql("SELECT mode, band FROM fr a WHERE NOT EXISTS (SELECT 1 FROM fr b WHERE (b.mode, b.band) <> (a.mode, a.band) AND b.turnover <= a.turnover AND b.tracking_error <= a.tracking_error + 1e-12 AND (b.turnover < a.turnover OR b.tracking_error < a.tracking_error))"))
def _(spark, d):
    return stats.pareto_front(_frontier(spark, d), "turnover", "tracking_error").select("mode", "band")


@query("frontier_dominance", _front_sql("SELECT NOT EXISTS (SELECT 1 FROM fr a WHERE a.mode = 'absolute' AND NOT EXISTS (SELECT 1 FROM fr l WHERE l.mode = 'log' AND l.turnover <= a.turnover + 1e-12 AND l.tracking_error <= a.tracking_error + 1e-12)) AS dominates"))
def _(spark, d):
    f = _frontier(spark, d)
    return stats.dominates(f.where("mode = 'log'"), f.where("mode = 'absolute'"), "turnover", "tracking_error")


@query("matched_pair", _front_sql(f"SELECT a.band AS absolute_band, l.band AS log_band, {s6('abs(a.turnover - l.turnover)', 'gap')} FROM fr a JOIN fr l ON a.mode = 'absolute' AND l.mode = 'log' ORDER BY abs(a.turnover - l.turnover), a.band, l.band LIMIT 1"))
def _(spark, d):
    f = _frontier(spark, d).select(F.lit("all").alias("of"), "band", "turnover", "mode")
    pair = stats.nearest_pair(f.where("mode = 'absolute'"), f.where("mode = 'log'"), "of", "turnover")
    return pair.select(F.col("a.band").alias("absolute_band"), F.col("b.band").alias("log_band"), r6("gap"))


# ---- significance

REPS, BLOCK, SEED, ALPHA_CI = 200, 21, 42, 0.05
LADDER = ["bh_market", "mom_only", "mom_ivol"]


def _u(kind: str, *parts: str) -> str:
    key = " || ':' || ".join(f"{p}::VARCHAR" for p in parts)
    return f"((('0x' || substr(md5('{SEED}:{kind}:' || {key}), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"


def _measured(name: str, source: str, by: str) -> str:
    """CTEs name_1 .. name: long metrics of series."""
    w = f"OVER (PARTITION BY {by} ORDER BY t ROWS UNBOUNDED PRECEDING)"
    long = " UNION ALL ".join(f"SELECT {by}, '{m}' AS metric, {m} AS value FROM {name}_3" for m in stats.METRICS)
    return f"""{name}_1 AS (SELECT *, exp(sum(ln(1 + ret)) {w}) AS nav FROM {source}), {name}_2 AS (SELECT *, nav / greatest(1, max(nav) {w}) - 1 AS fall FROM {name}_1),
{name}_3 AS (SELECT {by}, avg(excess) / stddev_samp(excess) * sqrt(252) AS sharpe, CASE WHEN min(fall) < 0 THEN (pow(arg_max(nav, t), 252.0 / count(*)) - 1) / abs(min(fall)) END AS calmar, min(fall) AS max_drawdown FROM {name}_2 GROUP BY {by}),
{name} AS ({long})"""



def _pairs_sql(pairs: list[tuple[str, str]]) -> str:
    return "pairs AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in pairs) + ") v(l, r))"


#: Draws for the strategies of a table pairs (l, r).
_DRAWS = f"""nm AS (SELECT * FROM (SELECT strategy_id, dense_rank() OVER (ORDER BY idx) - 1 AS t, raw AS ret, raw - rf AS excess FROM dd JOIN rf USING (idx) WHERE raw IS NOT NULL) WHERE strategy_id IN (SELECT l FROM pairs UNION ALL SELECT r FROM pairs)),
pl AS (SELECT rep, t, n FROM (SELECT unnest(range(0, {REPS})) AS rep), (SELECT unnest(range(0, max(t) + 1)) AS t, max(t) + 1 AS n FROM nm)),
bf AS (SELECT *, CASE WHEN t = 0 OR {_u('f', 'rep', 't')} < 1.0 / {BLOCK} THEN t END AS f, CASE WHEN t = 0 OR {_u('f', 'rep', 't')} < 1.0 / {BLOCK} THEN CAST(floor({_u('s', 'rep', 't')} * n) AS INT) END AS st FROM pl),
bd AS (SELECT rep, t, (last_value(st IGNORE NULLS) OVER w + t - last_value(f IGNORE NULLS) OVER w) % n AS "at" FROM bf WINDOW w AS (PARTITION BY rep ORDER BY t ROWS UNBOUNDED PRECEDING)),
sm AS (SELECT bd.rep, bd.t, nm.strategy_id, ret, excess FROM bd JOIN nm ON nm.t = bd."at"),
{_measured('bm', 'sm', 'rep, strategy_id')}, {_measured('ob', 'nm', 'strategy_id')},
od AS (SELECT x.metric, p.l, p.r, x.value - y.value AS point FROM pairs p JOIN ob x ON x.strategy_id = p.l JOIN ob y ON y.strategy_id = p.r AND y.metric = x.metric),
df AS (SELECT x.rep, x.metric, p.l, p.r, x.value - y.value AS diff FROM pairs p JOIN bm x ON x.strategy_id = p.l JOIN bm y ON y.strategy_id = p.r AND y.metric = x.metric AND y.rep = x.rep),
sw AS (SELECT rep, t, {_u('w', 'rep', 'block')} < 0.5 AS swap FROM (SELECT rep, t, sum(CASE WHEN {_u('p', 'rep', 't')} < 1.0 / {BLOCK} THEN 1 ELSE 0 END) OVER (PARTITION BY rep ORDER BY t ROWS UNBOUNDED PRECEDING) AS block FROM pl)),
sd AS (SELECT sw.rep, sw.t, p.l, p.r, s.side, CASE WHEN sw.swap = (s.side = 'r') THEN a.ret ELSE b.ret END AS ret, CASE WHEN sw.swap = (s.side = 'r') THEN a.excess ELSE b.excess END AS excess
  FROM sw JOIN pairs p ON TRUE JOIN (VALUES ('l'), ('r')) s(side) ON TRUE JOIN nm a ON a.strategy_id = p.l AND a.t = sw.t JOIN nm b ON b.strategy_id = p.r AND b.t = sw.t),
{_measured('pm', 'sd', 'rep, l, r, side')},
pd AS (SELECT rep, metric, l, r, max(CASE WHEN side = 'l' THEN value END) - max(CASE WHEN side = 'r' THEN value END) AS diff FROM pm GROUP BY 1, 2, 3, 4),
ci AS (SELECT metric, l, r, quantile_cont(diff, {ALPHA_CI / 2}) AS lo, quantile_cont(diff, {1 - ALPHA_CI / 2}) AS hi FROM df GROUP BY 1, 2, 3),
pv AS (SELECT metric, l, r, (count(CASE WHEN abs(diff) >= abs(point) - 1e-12 THEN 1 END) + 1.0) / (count(*) + 1) AS p_value FROM pd JOIN od USING (metric, l, r) GROUP BY 1, 2, 3)"""


def _draws_sql(body: str) -> str:
    return book_sql(f"SELECT * FROM (WITH {_pairs_sql([(b, a) for a, b in zip(LADDER, LADDER[1:], strict=False)])},\n{_DRAWS} {body})", LADDER)


def _ladder(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = cut(stats.numbered(_returns(Study(spark, d), LADDER)), "ladder", 1)
    return r, spark.createDataFrame([(b, a) for a, b in zip(LADDER, LADDER[1:], strict=False)], "left string, right string")


@query("ladder", _draws_sql(f"SELECT l AS richer, r AS simpler, metric, {s6('point', 'observed')}, {s6('lo')}, {s6('hi')}, lo > 0 OR hi < 0 AS excludes_zero, {s6('p_value')} FROM od JOIN ci USING (metric, l, r) JOIN pv USING (metric, l, r)"))
def _(spark, d):
    """Neighbouring strategies of the ladder: paired difference, its bootstrap interval and permutation p-value."""
    r, pairs = _ladder(spark, d)
    observed = cut(stats.pair_differences(stats.long_metrics(stats.sample_metrics(r, ["strategy_id"]), ["strategy_id"]), pairs, []), "observed", 1)
    ci = stats.pair_differences(stats.bootstrap(r, REPS, BLOCK, SEED), pairs, ["rep"]).groupBy("metric", "left", "right").agg(*stats.interval("diff", ALPHA_CI))
    p = stats.p_values(stats.permutation(r, pairs, REPS, BLOCK, SEED), observed)
    rows = observed.join(ci, ["metric", "left", "right"]).join(p, ["metric", "left", "right"])
    return rows.select(F.col("left").alias("richer"), F.col("right").alias("simpler"), "metric", r6("diff", "observed"), r6("lo"), r6("hi"), "excludes_zero", r6("p_value"))


@query("bootstrap_days", _draws_sql('SELECT rep, t, "at" FROM bd'))
def _(spark, d):
    r, _pairs = _ladder(spark, d)
    return stats.bootstrap_days(spark, r.agg(F.max("t")).first()[0] + 1, REPS, BLOCK, SEED)


@query("strategy_intervals", _draws_sql(f"SELECT strategy_id, metric, {s6('any_value(o.value)', 'point')}, {s6(f'quantile_cont(b.value, {ALPHA_CI / 2})', 'lo')}, {s6(f'quantile_cont(b.value, {1 - ALPHA_CI / 2})', 'hi')} FROM bm b JOIN ob o USING (strategy_id, metric) GROUP BY 1, 2"))
def _(spark, d):
    r, _pairs = _ladder(spark, d)
    point = stats.long_metrics(stats.sample_metrics(r, ["strategy_id"]), ["strategy_id"]).withColumnRenamed("value", "point")
    lo, hi, _zero = stats.interval("value", ALPHA_CI)
    ci = stats.bootstrap(r, REPS, BLOCK, SEED).groupBy("strategy_id", "metric").agg(lo, hi)
    return point.join(ci, ["strategy_id", "metric"]).select("strategy_id", "metric", r6("point"), r6("lo"), r6("hi"))


OTHERS = ["bh_market", "ew_menu", "sixty_forty", "mom_only", "mom_ivol", "voltarget_only"]


@query("full_vs_others", book_sql(f"""SELECT * FROM (WITH {_pairs_sql([('full', o) for o in OTHERS])},\n{_DRAWS}
  SELECT r AS vs, metric, {s6('point')}, {s6('lo')}, {s6('hi')}, lo > 0 OR hi < 0 AS excludes_zero FROM od JOIN ci USING (metric, l, r) WHERE metric <> 'max_drawdown')""", ["full", *OTHERS]))
def _(spark, d):
    """The full strategy against each other one on the same resampled days; strategies of different lengths are an error."""
    r = cut(stats.numbered(stats.aligned(_returns(Study(spark, d), ["full", *OTHERS]))), "returns", 1)
    pairs = spark.createDataFrame([("full", o) for o in OTHERS], "left string, right string")
    return _differences(r, pairs).where("metric <> 'max_drawdown'").select(F.col("right").alias("vs"), "metric", r6("point"), r6("lo"), r6("hi"), "excludes_zero")


def _differences(r: DataFrame, pairs: DataFrame) -> DataFrame:
    """(metric, left, right, point, lo, hi, excludes_zero): paired differences with their bootstrap intervals."""
    point = stats.pair_differences(stats.long_metrics(stats.sample_metrics(r, ["strategy_id"]), ["strategy_id"]), pairs, []).withColumnRenamed("diff", "point")
    ci = stats.pair_differences(stats.bootstrap(r, REPS, BLOCK, SEED), pairs, ["rep"]).groupBy("metric", "left", "right").agg(*stats.interval("diff", ALPHA_CI))
    return point.join(ci, ["metric", "left", "right"])


#: Strategies whose exposure bands are compared, and the cells of both modes.
BANDED = ("voltarget_only", "full")
BANDS = [c for c in CELLS if ":risk.exposure_band=" in c[0]]


def _banded_fold(name: str, sigma: str) -> dict:
    """CTEs of the exposures of all cells over the decisions of sigma."""
    n = f"SELECT *, row_number() OVER (PARTITION BY cell, epoch_idx ORDER BY idx) AS n, least(greatest(sigma_star / sigma_p, {C.e_min}), 1.0) AS e FROM {sigma} CROSS JOIN cells WHERE cell LIKE '%:risk.exposure_band=%'"
    f = f"""SELECT cell, epoch_idx, idx, exec_idx, n, e, e AS applied, FALSE AS blocked FROM nb_{name} WHERE n = 1
  UNION ALL SELECT b.cell, b.epoch_idx, b.idx, b.exec_idx, b.n, b.e, CASE WHEN g.gap > b.band THEN b.e ELSE f.applied END, NOT g.gap > b.band
  FROM fb_{name} f JOIN nb_{name} b ON b.cell = f.cell AND b.epoch_idx = f.epoch_idx AND b.n = f.n + 1, LATERAL (SELECT CASE WHEN b.band_mode = 'log' THEN abs(ln(b.e) - ln(f.applied)) ELSE abs(b.e - f.applied) END AS gap) g"""
    return {f"nb_{name}": ([sigma, "cells"], n), f"fb_{name}": ([f"nb_{name}"], f)}


def _banded_targets(name: str, routed: str) -> str:
    """Targets of a strategy's cells: risky weights times exposure, the rest in cash."""
    return f"""SELECT '{name}/' || f.cell AS strategy_id, f.idx AS decision_idx, f.exec_idx, r.ticker, r.weight * f.applied AS weight FROM fb_{name} f JOIN {routed} r ON r.epoch_idx = f.epoch_idx WHERE NOT f.blocked AND r.ticker <> 'CASH'
  UNION ALL SELECT '{name}/' || f.cell, f.idx, f.exec_idx, 'CASH', 1 - coalesce(sum(r.weight * f.applied), 0) FROM fb_{name} f LEFT JOIN {routed} r ON r.epoch_idx = f.epoch_idx AND r.ticker <> 'CASH' WHERE NOT f.blocked GROUP BY f.cell, f.idx, f.exec_idx"""


oracle.CTES |= _banded_fold("voltarget_only", "sig_one") | _banded_fold("full", "sig_ivol")
oracle.CTES["t_banded"] = (["fb_voltarget_only", "fb_full", "one", "routed"], _banded_targets("voltarget_only", "one") + " UNION ALL " + _banded_targets("full", "routed"))
_BAND_FRONT = f"""fr AS (SELECT split_part(strategy_id, '/', 1) AS strategy, split_part(split_part(strategy_id, '/', 2), ':', 1) AS mode, CAST(split_part(strategy_id, '=', 2) AS DOUBLE) AS band, turnover, abs(ann_vol - {C.sigma_star}) AS tracking_error, sharpe, strategy_id FROM ({_METRICS_RAW})),
near AS (SELECT * FROM (SELECT a.strategy, a.band AS absolute_band, l.band AS log_band, abs(a.turnover - l.turnover) AS gap, l.strategy_id AS l, a.strategy_id AS r, row_number() OVER (PARTITION BY a.strategy ORDER BY abs(a.turnover - l.turnover), a.band, l.band) AS place
  FROM fr a JOIN fr l ON a.strategy = l.strategy AND a.mode = 'absolute' AND l.mode = 'log') WHERE place = 1),
pairs AS (SELECT l, r FROM near)"""


def _banded(s: Study) -> backtest.Book:
    """The band's cells of every strategy in BANDED as one book, named <strategy>/<cell>."""
    cells = s.spark.createDataFrame(BANDS, _CELL)
    parts = [grid_targets(s, name, cells)[1].withColumn("strategy_id", F.concat(F.lit(f"{name}/"), "strategy_id")) for name in BANDED]
    return s.book_of(cut(reduce(DataFrame.unionByName, parts), "targets-banded"))


@query("band_pair_interval", book_sql(f"""SELECT * FROM (WITH {_BAND_FRONT},\n{_DRAWS}
  SELECT strategy AS strategy_id, absolute_band, log_band, {s6('gap')}, {s6('point')}, {s6('lo')}, {s6('hi')}, lo > 0 OR hi < 0 AS excludes_zero FROM near JOIN od USING (l, r) JOIN ci USING (metric, l, r) WHERE metric = 'sharpe')""", ["banded"]))
def _(spark, d):
    """Of each strategy the absolute and the logarithmic band whose turnovers lie nearest, and the interval of the
    difference of their Sharpe ratios, logarithmic less absolute."""
    s = Study(spark, d)
    b = _banded(s)
    f = cut(readers.frontier(metrics.bundle(b.nav, s.rf, b.weights), C.sigma_star), "banded-frontier", 1).select("strategy", "band", "turnover", "mode", "strategy_id")
    near = stats.nearest_pair(f.where("mode = 'absolute'"), f.where("mode = 'log'"), "strategy", "turnover")
    near = cut(near.select("strategy", F.col("a.band").alias("absolute_band"), F.col("b.band").alias("log_band"), "gap", F.col("b.strategy_id").alias("left"), F.col("a.strategy_id").alias("right")), "near", 1)
    named = near.select(F.explode(F.array("left", "right")).alias("strategy_id"))
    r = cut(stats.numbered(stats.aligned(_returns_of(b, s).join(F.broadcast(named), "strategy_id", "left_semi"))), "returns", 1)
    out = _differences(r, near.select("left", "right")).where("metric = 'sharpe'").join(near, ["left", "right"])
    return out.select(F.col("strategy").alias("strategy_id"), "absolute_band", "log_band", r6("gap"), r6("point"), r6("lo"), r6("hi"), "excludes_zero")


@query("return_alignment", book_sql("SELECT strategy_id, count(*) AS n, count(*) = (SELECT max(c) FROM (SELECT count(*) AS c FROM dd WHERE raw IS NOT NULL GROUP BY strategy_id)) AS aligned FROM dd WHERE raw IS NOT NULL GROUP BY 1", _FOUR))
def _(spark, d):
    n = _returns(Study(spark, d), _FOUR).groupBy("strategy_id").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("aligned", F.col("n") == F.max("n").over(Window.partitionBy()))


SPLITS = 16
_CELL_RETURNS = f"xr AS (SELECT strategy_id, idx, raw AS ret, raw - rf AS excess FROM dd JOIN rf USING (idx) WHERE raw IS NOT NULL), {_moments_sql('xr')}"
_TRIAL = f"sqrt((SELECT var_samp(sr) FROM mo)) * {stats.max_quantile(len(CELLS))!r}"


@query("significance_report", book_sql(f"""SELECT * FROM (WITH {_CELL_RETURNS}, {_PBO}
  SELECT 'voltarget_only' AS strategy_id, {len(CELLS)}::BIGINT AS trials, n AS n_days, {s6('sr')}, {s6('skew')}, {s6('kurt')}, {s6(_psr_sql('0.0'), 'psr')}, {s6(_TRIAL, 'expected_max_sr')}, {s6(_psr_sql(_TRIAL), 'dsr')},
    (SELECT {s6('var_samp(sr)', 'v')} FROM mo) AS sr_variance, (SELECT {s6('avg(CASE WHEN ln(rk / (k + 1) / (1 - rk / (k + 1))) <= 0 THEN 1.0 ELSE 0.0 END)', 'v')} FROM pk WHERE pick = 1) AS pbo FROM mo WHERE strategy_id = 'baseline')""", ["cells"]))
def _(spark, d):
    """The volatility target's baseline against its grid: every cell is a trial; Sharpe ratios per period, over cash; the
    probability of overfitting from SPLITS blocks."""
    b, s = _cell_book(spark, d)
    r = cut(_returns_of(b, s), "cell-returns")
    m = stats.moments(r, "excess")
    spread = m.agg(F.var_samp("sr").alias("sr_variance"))
    pbo = stats.overfitting(r, SPLITS).agg(F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"))
    m = m.where("strategy_id = 'baseline'").join(F.broadcast(spread)).join(F.broadcast(pbo))
    m = m.withColumn("expected_max_sr", stats.expected_max_sharpe(F.col("sr_variance"), len(CELLS)))
    args = [F.col(c) for c in ("sr", "n", "skew", "kurt")]
    return m.select(
        F.lit("voltarget_only").alias("strategy_id"), F.lit(len(CELLS)).cast("long").alias("trials"), F.col("n").alias("n_days"), r6("sr"), r6("skew"), r6("kurt"),
        r6(stats.psr(*args, F.lit(0.0)), "psr"), r6("expected_max_sr"), r6(stats.psr(*args, F.col("expected_max_sr")), "dsr"), r6("sr_variance"), r6("pbo"),
    )


_Q = """CASE WHEN p < 0.02425 THEN {c} WHEN p > 0.97575 THEN -({d}) ELSE {m} END"""


def _horner(cs: tuple[float, ...], x: str) -> str:
    return reduce(lambda a, c: f"({a} * {x} + {c!r})", cs[1:], repr(cs[0]))


_NORMAL = _Q.format(
    c=f"{_horner(stats._C, 'sqrt(-2 * ln(p))')} / {_horner(stats._D, 'sqrt(-2 * ln(p))')}", d=f"{_horner(stats._C, 'sqrt(-2 * ln(1 - p))')} / {_horner(stats._D, 'sqrt(-2 * ln(1 - p))')}",
    m=f"(p - 0.5) * {_horner(stats._A, '((p - 0.5) * (p - 0.5))')} / {_horner(stats._B, '((p - 0.5) * (p - 0.5))')}",
)


@query("residual_qq", sql(f"SELECT ticker, k, {s6(_NORMAL, 'theory')}, {s6('e')} FROM (SELECT ticker, e, k2 AS k, (k2 - 0.5) / n AS p FROM (SELECT ticker, e, row_number() OVER (PARTITION BY ticker ORDER BY e, idx) AS k2, count(*) OVER (PARTITION BY ticker) AS n FROM resid))", ["resid"]))
def _(spark, d):
    rows = stats.quantile_pairs(volatility.ewma_residuals(market.panel(spark, d), C.lam), "ticker", "e")
    return rows.select("ticker", "k", r6("theory"), r6("e"))


# ---- decisions as flat rows, and what reads them

_NUM = "printf('%.6f', round({0}, 6) + 0.0)"


def _map_sql(value: str) -> str:
    return f"'{{' || string_agg('\"' || ticker || '\": ' || {value}, ', ' ORDER BY ticker) || '}}'"


_FLAT = f"""fd AS (SELECT v.epoch_idx AS decision_idx, v.exec_idx, 'mom_ivol' AS strategy_id, 'selection' AS event, '[' || string_agg('"' || v.ticker || '"', ', ' ORDER BY s.rank) || ']' AS selected, {_map_sql(_NUM.format('s.score')).replace('ticker', 'v.ticker')} AS momentum_scores,
  {_map_sql("CASE WHEN v.passes THEN 'true' ELSE 'false' END").replace('ticker', 'v.ticker')} AS absmom, {_map_sql(_NUM.format('v.weight')).replace('ticker', 'v.ticker')} AS w_risky FROM ivol v JOIN sel s ON s.idx = v.epoch_idx AND s.ticker = v.ticker GROUP BY 1, 2)"""


def _decisions(s: Study) -> DataFrame:
    rows = s._risky().join(s.selection.select(F.col("idx").alias("decision_idx"), "ticker", "score", "rank"), ["decision_idx", "ticker"])
    return s.once("decisions", lambda: readers.flat_decisions(rows.withColumn("strategy_id", F.lit("mom_ivol"))))


@query("decisions_flat", sql("SELECT * FROM fd", ["ivol", "sel"], _FLAT))
def _(spark, d):
    return _decisions(Study(spark, d))


@query("decisions_parsed", sql(f"SELECT epoch_idx AS decision_idx, ticker, passes, {s6('weight')} FROM ivol", ["ivol"]))
def _(spark, d):
    return readers.parsed_decisions(_decisions(Study(spark, d))).select("decision_idx", "ticker", "passes", r6("weight"))


@query("cash_fraction", sql(f"SELECT epoch_idx AS decision_idx, {s6('coalesce(sum(CASE WHEN NOT passes THEN round(weight, 6) END), 0)', 'cash')} FROM ivol GROUP BY 1", ["ivol"]))
def _(spark, d):
    return readers.cash_fraction(_decisions(Study(spark, d))).select("decision_idx", r6("cash"))


_COND = """cf AS (SELECT exec_idx, coalesce(sum(CASE WHEN NOT passes THEN round(weight, 6) END), 0) AS cash FROM ivol WHERE exec_idx IS NOT NULL GROUP BY 1),
gv AS (SELECT d.idx, d.raw, (SELECT arg_max(cash, exec_idx) FROM cf WHERE cf.exec_idx < d.idx) AS cash FROM dd d WHERE raw IS NOT NULL)"""


@query("conditional_vol", book_sql(f"SELECT * FROM (WITH {_COND} SELECT v.threshold, {s6('stddev_samp(CASE WHEN cash <= v.threshold THEN raw END) * sqrt(252)', 'realized_vol')}, count(CASE WHEN cash <= v.threshold THEN 1 END) AS n_included, count(*) AS n_total, coalesce(abs(stddev_samp(CASE WHEN cash <= v.threshold THEN raw END) * sqrt(252) - {C.sigma_star}) <= 0.02, FALSE) AS passes FROM gv, (VALUES (0.0), (0.2)) v(threshold) GROUP BY 1)", ["mom_ivol"]))
def _(spark, d):
    """Volatility of the days that a selection with little cash governs: the last one executed before the day."""
    s = Study(spark, d)
    nav = metrics.with_drawdown(s.book("mom_ivol").nav).where("raw is not null")
    out = readers.conditional_vol(readers.cash_fraction(_decisions(s)), nav, [0.0, 0.2], C.sigma_star, 0.02)
    return out.select("threshold", r6("realized_vol"), "n_included", "n_total", "passes")


_LAYERS = f"""lz AS (SELECT max(epoch_idx) AS last FROM ivol), ly AS (SELECT 'eligible' AS layer, ticker AS key, 1.0 AS value FROM panel, lz WHERE idx = last AND n >= {C.min_history}
  UNION ALL SELECT 'momentum', ticker, round(score, 6) FROM sel, lz WHERE idx = last UNION ALL SELECT 'selected', ticker, rank FROM sel, lz WHERE idx = last UNION ALL SELECT 'absolute', ticker, CASE WHEN passes THEN 1.0 ELSE 0.0 END FROM ivol, lz WHERE epoch_idx = last
  UNION ALL SELECT 'weight', ticker, round(weight, 6) FROM ivol, lz WHERE epoch_idx = last UNION ALL SELECT 'target', ticker, round(weight, 6) FROM routed, lz WHERE epoch_idx = last)"""


@query("decision_layers", sql(f"SELECT layer, key, {s6('value')} FROM ly", ["ivol", "sel", "panel", "routed"], _LAYERS))
def _(spark, d):
    s = Study(spark, d)
    one = readers.decision_at(_decisions(s), "mom_ivol", None)
    day = one.select("decision_idx")
    eligible = signals.eligible(s.panel, C).join(F.broadcast(day), F.col("idx") == F.col("decision_idx")).select("ticker")
    target = s._mom_ivol().join(F.broadcast(day), "decision_idx").select("ticker", "weight")
    return readers.layers(one, eligible, target).select("layer", "key", r6("value"))


@query("decisions_at_dates", sql("SELECT q.day AS asked_date, (SELECT max(c.date) FROM clock c WHERE c.is_selection AND c.date <= q.day) AS decision_date, (SELECT max(c.date) FROM clock c WHERE c.is_selection AND c.date < (SELECT max(e.date) FROM clock e WHERE e.is_selection AND e.date <= q.day)) AS previous_date FROM (SELECT DISTINCT CAST(date_trunc('quarter', date) AS DATE) AS day FROM days) q WHERE (SELECT max(c.date) FROM clock c WHERE c.is_selection AND c.date <= q.day) IS NOT NULL", ["clock", "days"]))
def _(spark, d):
    s = Study(spark, d)
    asked = s.rf.select(F.to_date(F.date_trunc("quarter", "date")).alias("day")).distinct()
    return readers.nearest_before(asked, s.clock.where("is_selection").select(F.col("date").alias("decision_date"))).withColumnRenamed("day", "asked_date")


@query("momentum_ranking", sql(f"SELECT s.ticker, {s6('score')}, row_number() OVER (ORDER BY score DESC, s.ticker) AS place, s.ticker IN (SELECT ticker FROM sel WHERE idx = s.idx) AS selected FROM scores s WHERE s.idx = (SELECT max(idx) FROM sel) AND score IS NOT NULL", ["scores", "sel"]))
def _(spark, d):
    s = Study(spark, d)
    last = s.selection.agg(F.max("idx").alias("idx"))
    scores = signals.momentum(s.panel, C).join(F.broadcast(last), "idx").where("score is not null").select("idx", "ticker", "score")
    return readers.ranking(scores, s.selection.select("idx", "ticker")).select("ticker", r6("score"), "place", "selected")


@query("correlation_matrix", sql(f"SELECT ticker_i, {', '.join(s6(f'max(CASE WHEN j = {k} THEN corr END)', f'c{k}') for k in range(1, 6))} FROM (SELECT *, dense_rank() OVER (ORDER BY ticker_j) AS j FROM cr) GROUP BY 1", _BASE, f"{_FIVE},{_PAIRS},{_EWC},{_UNIT}"))
def _(spark, d):
    c = correlation.ewma_corr(_last_pairs(Study(spark, d)), C.lam)
    square = readers.square(c, "ticker_i", "ticker_j", "corr", 5)
    return square.select("ticker_i", *(r6(f"c{k}") for k in range(1, 6)))


_MENU = [f"Brand#{i}" for i in range(1, 26)]


@query("price_panel", sql("SELECT date, " + ", ".join(f"max(CASE WHEN ticker = '{t}' THEN p END) AS \"{t}\"" for t in _MENU) + " FROM panel GROUP BY 1", ["panel"]))
def _(spark, d):
    return Study(spark, d).panel.groupBy("date").pivot("ticker", _MENU).agg(F.max("p"))


@query("pair_correlation_series", sql(f"SELECT c.idx, c.ticker_i, c.ticker_j, {s6('c.s / sqrt(a.s * b.s)', 'corr')} FROM s_ivol c JOIN s_ivol a ON a.idx = c.idx AND a.ticker_i = c.ticker_i AND a.ticker_j = c.ticker_i JOIN s_ivol b ON b.idx = c.idx AND b.ticker_i = c.ticker_j AND b.ticker_j = c.ticker_j WHERE c.ticker_i < c.ticker_j", ["s_ivol"]))
def _(spark, d):
    s = Study(spark, d)
    chosen = s._risky().select(F.col("decision_idx").alias("epoch_idx"), "ticker")
    rows = s.covariances(s.epochs().join(chosen, "epoch_idx"))
    return rows.where("ticker_i < ticker_j").select("idx", "ticker_i", "ticker_j", r6("corr"))


@query("price_trades_panel", book_sql(f"SELECT p.idx, {s6('p.p', 'price')}, {s6('coalesce(w.weight, 0)', 'weight')}, t.side, {s6('t.delta', 'delta_weight')} FROM panel p LEFT JOIN (SELECT * FROM wts WHERE ticker = '{C.market}') w ON w.idx = p.idx LEFT JOIN (SELECT exec_idx, CASE WHEN target_weight > drifted_weight THEN 'BUY' ELSE 'SELL' END AS side, target_weight - drifted_weight AS delta FROM trades WHERE ticker = '{C.market}' AND abs(target_weight - drifted_weight) > 1e-12) t ON t.exec_idx = p.idx WHERE p.ticker = '{C.market}'", ["mom_only"]))
def _(spark, d):
    s = Study(spark, d)
    b = s.book("mom_only")
    return readers.price_trades(s.panel, b, "mom_only", C.market).select("idx", r6("price"), r6("weight"), "side", r6("delta_weight"))


@query("blotter_page", book_sql(f"SELECT exec_idx, ticker, {s6('target_weight - drifted_weight', 'delta_weight')} FROM trades WHERE ticker <> 'CASH' AND abs(target_weight - drifted_weight) > 1e-12 ORDER BY exec_idx DESC, ticker LIMIT 50 OFFSET 50", ["mom_only"]))
def _(spark, d):
    return readers.page(Study(spark, d).book("mom_only").trades, 2).select("exec_idx", "ticker", r6("delta_weight"))


@query("blotter_csv", book_sql(f"SELECT exec_idx, ticker, {s6('target_weight - drifted_weight', 'delta_weight')} FROM trades WHERE ticker <> 'CASH' AND abs(target_weight - drifted_weight) > 1e-12", ["mom_only"]))
def _(spark, d):
    """The blotter as CSV and read back."""
    rows = Study(spark, d).book("mom_only").trades.select("exec_idx", "ticker", "delta_weight")
    path = new_path(spark, "blotter")
    readers.write_csv(rows, path)
    return readers.read_csv(spark, path, "exec_idx int, ticker string, delta_weight double").select("exec_idx", "ticker", r6("delta_weight"))


_RUN = ["bh_market", "mom_only"]


@query("run_artifacts", book_sql("SELECT 'nav' AS artifact, strategy_id, count(*) AS n_rows FROM nav GROUP BY 2 UNION ALL SELECT 'weights', strategy_id, count(*) FROM wts GROUP BY 2 UNION ALL SELECT 'trades', strategy_id, count(*) FROM trades WHERE ticker <> 'CASH' AND abs(target_weight - drifted_weight) > 1e-12 GROUP BY 2", _RUN))
def _(spark, d):
    """A run of several strategies written as artefacts by strategy, found in the catalogue and read back."""
    s = Study(spark, d)
    root = new_path(spark, "runs")
    readers.write_run(s.book(*_RUN), f"{root}/first", C)
    return readers.catalogue(spark, root, ["first", "absent"]).select("artifact", "strategy_id", "n_rows")


_SHELF = ["bh_market", "mom_ivol"]
_COUNTS = """ct AS (SELECT 'nav' AS artifact, strategy_id, count(*) AS n_rows FROM nav GROUP BY 2 UNION ALL SELECT 'weights', strategy_id, count(*) FROM wts GROUP BY 2 UNION ALL SELECT 'trades', strategy_id, count(*) FROM trades WHERE ticker <> 'CASH' AND abs(target_weight - drifted_weight) > 1e-12 GROUP BY 2
  UNION ALL SELECT 'decisions', 'mom_ivol', count(DISTINCT epoch_idx) FROM ivol UNION ALL SELECT 'comparison', strategy_id, 1 FROM dd GROUP BY 2)"""


@query("run_catalogue", book_sql("SELECT run, complete, reason, newest, artifact, strategy_id, n_rows * CASE WHEN run = 'grown' AND artifact = 'nav' THEN 2 ELSE 1 END AS n_rows FROM (VALUES ('early', TRUE, NULL, FALSE), ('late', TRUE, NULL, TRUE), ('torn', FALSE, 'no manifest', FALSE), ('grown', FALSE, 'rows differ: nav', FALSE)) v(run, complete, reason, newest) JOIN ct ON run <> 'torn' OR artifact = 'nav'", _SHELF).replace("\nSELECT run,", f",\n{_COUNTS}\nSELECT run,"))
def _(spark, d):
    """Runs found below a folder: two whole ones, one without its manifest and one whose table grew after it."""
    s = Study(spark, d)
    shelf, book = new_path(spark, "shelf"), s.book(*_SHELF)
    book = backtest.Book(*(cut(df, name) for df, name in ((book.nav, "nav"), (book.weights, "weights"), (book.trades, "trades"))))
    more = {"decisions": _decisions(s), "comparison": cut(metrics.bundle(book.nav, s.rf, book.weights), "comparison", 1)}
    for run in ("early", "late", "grown"):
        readers.write_run(book, f"{shelf}/{run}", C, **more)
        if run == "late":
            book.nav.write.partitionBy("strategy_id").parquet(f"{shelf}/torn/nav")
    book.nav.write.mode("append").partitionBy("strategy_id").parquet(f"{shelf}/grown/nav")
    return readers.found_artifacts(spark, shelf).join(readers.runs(spark, shelf), "run").select("run", "complete", "reason", "newest", "artifact", "strategy_id", "n_rows")


@query("garch_parameters")
def _(spark, d):
    """Parameters and persistence of each refit, and how often a ticker fell back."""
    s = Study(spark, d)
    days = s.clock.where("is_selection").orderBy(F.desc("idx")).limit(6).select("idx")
    fits = cut(volatility.refit(s.panel, s.selection.select("ticker", "idx").join(F.broadcast(days), "idx").repartition("ticker", "idx"), C.horizon), "fits")
    return readers.parameter_track(fits).select("ticker", "idx", *(r6(c) for c in ("omega", "alpha", "beta", "nu", "persistence", "fallback_rate")))


_SEE = ", ".join(s6(k) for k in readers.SHOWN)


@query("overview", book_sql(f"SELECT 'metrics' AS part, strategy_id, 'all' AS period, n_days, {_SEE} FROM ({_METRICS_RAW}) UNION ALL SELECT 'subperiod', strategy_id, period, n_days, {_SEE} FROM {_SUBPERIODS} WHERE strategy_id = '{_FOUR[0]}'", _FOUR))
def _(spark, d):
    """The overview page: metrics of all strategies, and the first one's by period."""
    s = Study(spark, d)
    b = s.book(*_FOUR)
    return readers.overview(b.nav, b.weights, s.rf, _spans(s), _FOUR).select("part", "strategy_id", "period", "n_days", *(r6(k) for k in readers.SHOWN))
