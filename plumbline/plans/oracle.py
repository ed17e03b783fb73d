"""DuckDB SQL of the registered queries: common table expressions by name, joined as a query needs them."""

from __future__ import annotations

from plumbline.operators.signals import Config

C = Config()
WARM = max(C.lookback + 1, C.min_history)


def _bars(where: str = "TRUE", ticker: str = "p_brand") -> str:
    return f"""SELECT {ticker} AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, round(100 * (1 + avg(l_discount) - avg(l_tax)), 6) AS close, sum(l_quantity) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {where} GROUP BY 1, 2"""


def _scaled(name: str, routed: str, expo: str) -> str:
    return f"""SELECT '{name}' AS strategy_id, e.idx AS decision_idx, e.exec_idx, r.ticker, r.weight * e.applied AS weight FROM {routed} r JOIN {expo} e ON r.epoch_idx = e.epoch_idx WHERE NOT e.blocked AND r.ticker <> 'CASH'
  UNION ALL SELECT '{name}', e.idx, e.exec_idx, 'CASH', 1 - coalesce(sum(r.weight * e.applied), 0) FROM {expo} e LEFT JOIN {routed} r ON r.epoch_idx = e.epoch_idx AND r.ticker <> 'CASH' WHERE NOT e.blocked GROUP BY e.idx, e.exec_idx"""


def _sigma(weights: str, vol: str = "vol") -> str:
    """Portfolio volatility at every decision, by explicit weighted sums over each decision's own past."""
    return f"""SELECT d.epoch_idx, d.idx, d.exec_idx, sqrt(greatest(sum(a.weight * va.vol * (CASE WHEN a.ticker = b.ticker THEN 1.0 ELSE c.s / sqrt(ca.s * cb.s) END) * vb.vol * b.weight), 0)) AS sigma_p
  FROM epochs d JOIN {weights} a ON a.epoch_idx = d.epoch_idx JOIN {weights} b ON b.epoch_idx = d.epoch_idx
  JOIN {vol} va ON va.ticker = a.ticker AND va.idx = d.idx JOIN {vol} vb ON vb.ticker = b.ticker AND vb.idx = d.idx
  JOIN s_{weights} c ON c.idx = d.idx AND c.ticker_i = a.ticker AND c.ticker_j = b.ticker
  JOIN s_{weights} ca ON ca.idx = d.idx AND ca.ticker_i = a.ticker AND ca.ticker_j = a.ticker JOIN s_{weights} cb ON cb.idx = d.idx AND cb.ticker_i = b.ticker AND cb.ticker_j = b.ticker
  GROUP BY 1, 2, 3"""


def _window(weights: str) -> str:
    """The last 1000 returns of each ticker up to each decision."""
    return f"""SELECT t.idx AS dt, t.epoch_idx, t.ticker, a.idx, a.r, row_number() OVER (PARTITION BY t.idx, t.ticker ORDER BY a.idx) AS k
  FROM (SELECT DISTINCT d.idx, d.epoch_idx, a.ticker FROM epochs d JOIN {weights} a USING (epoch_idx)) t JOIN ret a ON a.ticker = t.ticker AND a.idx <= t.idx AND a.idx > t.idx - 1000"""


def _resid(weights: str) -> str:
    """Residuals known at a decision, seeded by the variance of its own window."""
    return f"""SELECT a.dt, a.ticker, a.idx, a.r / sqrt(pow({C.lam}, a.k - 1) * h.h + (1 - {C.lam}) * coalesce(sum(pow({C.lam}, a.k - 1 - b.k) * b.r * b.r), 0)) AS e
  FROM w_{weights} a JOIN (SELECT dt, ticker, var_samp(r) AS h FROM w_{weights} GROUP BY 1, 2) h ON h.dt = a.dt AND h.ticker = a.ticker LEFT JOIN w_{weights} b ON b.dt = a.dt AND b.ticker = a.ticker AND b.k < a.k GROUP BY a.dt, a.ticker, a.idx, a.k, a.r, h.h"""


def _shared(weights: str) -> str:
    """Residuals on the days that all tickers of a decision share."""
    return f"""SELECT e.*, q.k, q.n FROM r_{weights} e JOIN (SELECT dt, idx, row_number() OVER (PARTITION BY dt ORDER BY idx) AS k, count(*) OVER (PARTITION BY dt) AS n FROM (SELECT dt, idx, count(*) AS c FROM r_{weights} GROUP BY 1, 2)
  JOIN (SELECT dt, count(DISTINCT ticker) AS m FROM w_{weights} GROUP BY 1) USING (dt) WHERE c = m) q ON q.dt = e.dt AND q.idx = e.idx"""


def _sums(weights: str, start: str, step: str) -> str:
    """Correlation sums of two residual series at a decision, the day's own product left out."""
    return f"""SELECT x.dt AS idx, x.ticker AS ticker_i, y.ticker AS ticker_j, {start} + coalesce(sum(CASE WHEN x.k < x.n THEN {step} * x.e * y.e END), 0) AS s
  FROM x_{weights} x JOIN x_{weights} y ON y.dt = x.dt AND y.idx = x.idx GROUP BY x.dt, x.ticker, y.ticker, x.n"""


_EWMA_SUMS = f"pow({C.lam}, x.n - 1) * covar_samp(x.e, y.e)", f"(1 - {C.lam}) * pow({C.lam}, x.n - 1 - x.k)"
A, B = 0.01, 0.96
_DCC_SUMS = f"(pow({B}, x.n - 1) + (1 - {A} - {B}) * (1 - pow({B}, x.n - 1)) / (1 - {B})) * (0.9 * corr(x.e, y.e) + CASE WHEN x.ticker = y.ticker THEN 0.1 ELSE 0 END)", f"{A} * pow({B}, x.n - 1 - x.k)"


def _fold(sigma: str) -> str:
    return f"""SELECT epoch_idx, idx, exec_idx, sigma_p, e AS exposure, applied, blocked FROM f_{sigma}"""


def _band(sigma: str) -> str:
    """The hysteresis band as a recursion over the decisions of an epoch."""
    return f"""SELECT epoch_idx, idx, exec_idx, sigma_p, n, e, e AS applied, FALSE AS blocked FROM n_{sigma} WHERE n = 1
  UNION ALL SELECT b.epoch_idx, b.idx, b.exec_idx, b.sigma_p, b.n, b.e, CASE WHEN abs(b.e - f.applied) > {C.band} THEN b.e ELSE f.applied END, NOT abs(b.e - f.applied) > {C.band}
  FROM f_{sigma} f JOIN n_{sigma} b ON b.epoch_idx = f.epoch_idx AND b.n = f.n + 1"""


def _numbered(sigma: str) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY epoch_idx ORDER BY idx) AS n, least(greatest({C.sigma_star} / sigma_p, {C.e_min}), 1.0) AS e FROM {sigma}"


CTES: dict[str, tuple[list[str], str]] = {
    "bars": ([], _bars()),
    "bars_val": ([], _bars("l_linestatus = 'O'")),
    "bars_arb": ([], _bars("l_returnflag <> 'N'")),
    "days": (["bars"], "SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM bars)"),
    "grid": (["bars", "days"], "SELECT t.ticker, d.date, d.idx, b.close FROM days d CROSS JOIN (SELECT DISTINCT ticker FROM bars) t LEFT JOIN bars b ON b.ticker = t.ticker AND b.date = d.date"),
    "panel0": (["grid"], "SELECT ticker, date, idx, p FROM (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS p FROM grid) WHERE p IS NOT NULL"),
    "panel": (["panel0"], "SELECT *, p / lag(p) OVER w - 1 AS r, row_number() OVER w AS n FROM panel0 WINDOW w AS (PARTITION BY ticker ORDER BY date)"),
    "rates": ([], "SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS date, round(1 + 4 * avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS DTB3 FROM orders GROUP BY 1"),
    "rf": (["days", "rates"], """SELECT date, idx, coalesce(last_value(DTB3 IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), first_value(DTB3 IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) / 100 / 252 AS rf
  FROM days LEFT JOIN rates USING (date)"""),
    "clock": (["days"], f"""SELECT date, idx, idx - {WARM} AS "offset", (idx - {WARM}) % {C.selection} = 0 AS is_selection, (idx - {WARM}) % {C.check} = 0 AS is_check, exec_idx
  FROM (SELECT *, lead(idx) OVER (ORDER BY date) AS exec_idx FROM days) WHERE idx >= {WARM}"""),
    "scores": (["panel"], f"""SELECT *, lag(p, {C.skip}) OVER w / lag(p, {C.lookback}) OVER w - 1 AS score, p / lag(p, {C.lookback}) OVER w - 1 AS total FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date)"""),
    "hurdle": (["rf"], f"SELECT date, exp(sum(ln(1 + rf)) OVER (ORDER BY date ROWS BETWEEN {C.lookback - 1} PRECEDING AND CURRENT ROW)) - 1 AS hurdle FROM rf"),
    "absmom": (["scores", "hurdle"], "SELECT s.*, hurdle, total > hurdle AS passes FROM scores s JOIN hurdle USING (date)"),
    "sel": (["absmom", "clock"], f"""SELECT * FROM (SELECT a.date, a.idx, c.exec_idx, ticker, score, row_number() OVER (PARTITION BY a.date ORDER BY score DESC, ticker) AS rank, passes
  FROM absmom a JOIN clock c USING (idx) WHERE is_selection AND score IS NOT NULL AND n >= {C.min_history}) WHERE rank <= {C.top_k}"""),
    "ret": (["panel"], "SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS k FROM panel WHERE r IS NOT NULL"),
    "ewma": (["ret"], f"""SELECT a.ticker, a.date, a.idx, a.k, pow({C.lam}, a.k) * var_samp(b.r) + (1 - {C.lam}) * sum(pow({C.lam}, a.k - b.k) * b.r * b.r) AS variance
  FROM ret a JOIN ret b ON a.ticker = b.ticker AND b.k <= a.k GROUP BY a.ticker, a.date, a.idx, a.k"""),
    "vol": (["ewma"], "SELECT ticker, date, idx, k, variance, sqrt(variance) * sqrt(252) AS vol FROM ewma"),
    "resid": (["ret"], f"""SELECT a.ticker, a.date, a.idx, a.k, a.r / sqrt(pow({C.lam}, a.k - 1) * s.h + (1 - {C.lam}) * coalesce(sum(pow({C.lam}, a.k - 1 - b.k) * b.r * b.r), 0)) AS e
  FROM ret a JOIN (SELECT ticker, var_samp(r) AS h FROM ret GROUP BY ticker) s USING (ticker) LEFT JOIN ret b ON a.ticker = b.ticker AND b.k < a.k GROUP BY a.ticker, a.date, a.idx, a.k, a.r, s.h"""),
    "epochs": (["clock"], "SELECT last_value(CASE WHEN is_selection THEN idx END IGNORE NULLS) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING) AS epoch_idx, idx, exec_idx FROM clock WHERE is_selection OR is_check"),
    "ivol": (["sel", "vol"], "SELECT s.idx AS epoch_idx, s.exec_idx, s.ticker, passes, (1 / v.vol) / sum(1 / v.vol) OVER (PARTITION BY s.idx) AS weight FROM sel s JOIN vol v ON v.ticker = s.ticker AND v.idx = s.idx"),
    "routed": (["ivol"], """SELECT epoch_idx, exec_idx, ticker, weight FROM ivol WHERE passes
  UNION ALL SELECT epoch_idx, exec_idx, 'CASH', coalesce(sum(CASE WHEN NOT passes THEN weight END), 0) FROM ivol GROUP BY 1, 2"""),
    "one": (["clock"], f"SELECT idx AS epoch_idx, '{C.market}' AS ticker, 1.0 AS weight FROM clock WHERE is_selection"),
    **{f"w_{w}": ([w, "epochs", "ret"], _window(w)) for w in ("ivol", "one")},
    **{f"r_{w}": ([f"w_{w}"], _resid(w)) for w in ("ivol", "one")},
    **{f"x_{w}": ([f"r_{w}", f"w_{w}"], _shared(w)) for w in ("ivol", "one", "gvol")},
    **{f"s_{w}": ([f"x_{w}"], _sums(w, *_EWMA_SUMS)) for w in ("ivol", "one")},
    # equal risk contributions by cyclical descent, 100 sweeps
    "e_cov": (["s_ivol", "vol", "epochs"], """SELECT c.idx AS epoch_idx, c.ticker_i, c.ticker_j, a.vol * CASE WHEN c.ticker_i = c.ticker_j THEN 1.0 ELSE c.s / sqrt(x.s * y.s) END * b.vol AS cov
  FROM s_ivol c JOIN s_ivol x ON x.idx = c.idx AND x.ticker_i = c.ticker_i AND x.ticker_j = c.ticker_i JOIN s_ivol y ON y.idx = c.idx AND y.ticker_i = c.ticker_j AND y.ticker_j = c.ticker_j
  JOIN vol a ON a.ticker = c.ticker_i AND a.idx = c.idx JOIN vol b ON b.ticker = c.ticker_j AND b.idx = c.idx WHERE c.idx IN (SELECT epoch_idx FROM epochs)"""),
    "e_mat": (["e_cov"], """SELECT epoch_idx, len(tick) AS k, m, tick, x FROM (SELECT epoch_idx, list(cov ORDER BY ticker_i, ticker_j) AS m FROM e_cov GROUP BY 1)
  JOIN (SELECT epoch_idx, list(ticker_i ORDER BY ticker_i) AS tick, list(1 / sqrt(cov) ORDER BY ticker_i) AS x FROM e_cov WHERE ticker_i = ticker_j GROUP BY 1) USING (epoch_idx)"""),
    "e_step": (["e_mat"], """SELECT epoch_idx, 0::BIGINT AS n, k, m, tick, x FROM e_mat UNION ALL
  SELECT epoch_idx, n + 1, k, m, tick, list_transform(x, lambda v, j: CASE WHEN j = i THEN (-c + sqrt(c * c + 4 * o / k)) / (2 * o) ELSE v END)
  FROM (SELECT *, list_sum(list_transform(x, lambda v, j: m[(i - 1) * k + j] * v)) - m[(i - 1) * k + i] * x[i] AS c, m[(i - 1) * k + i] AS o FROM (SELECT *, n % k + 1 AS i FROM e_step WHERE n < 100 * k))"""),
    "ercw": (["e_step", "pick"], "SELECT p.epoch_idx, p.exec_idx, p.ticker, p.passes, w.weight FROM (SELECT epoch_idx, unnest(tick) AS ticker, unnest(x) / list_sum(x) AS weight FROM e_step WHERE n = 100 * k) w JOIN pick p ON p.epoch_idx = w.epoch_idx AND p.ticker = w.ticker"),
    "e_routed": (["ercw"], """SELECT epoch_idx, exec_idx, ticker, weight FROM ercw WHERE passes
  UNION ALL SELECT epoch_idx, exec_idx, 'CASH', coalesce(sum(CASE WHEN NOT passes THEN weight END), 0) FROM ercw GROUP BY 1, 2"""),
    "s_ercw": (["s_ivol"], "SELECT * FROM s_ivol"),
    "sig_ercw": (["s_ercw", "ercw", "vol", "epochs"], _sigma("ercw")),
    "n_sig_ercw": (["sig_ercw"], _numbered("sig_ercw")),
    "f_sig_ercw": (["n_sig_ercw"], _band("sig_ercw")),
    "e_ercw": (["f_sig_ercw"], _fold("sig_ercw")),
    "t_full_erc": (["e_routed", "e_ercw"], _scaled("full_erc", "e_routed", "e_ercw")),
    # GARCH by variance targeting at each selection, filtered on by its epoch's parameters
    "pick": (["sel"], "SELECT idx AS epoch_idx, exec_idx, ticker, passes FROM sel"),
    "w_gvol": (["pick", "epochs", "ret"], _window("pick")),
    "g_par": (["w_gvol"], "SELECT epoch_idx, ticker, 100 * avg(r) AS mu, 1e4 * var_pop(r) * (1 - 0.05 - 0.9) AS omega FROM w_gvol WHERE dt = epoch_idx GROUP BY 1, 2"),
    "g_row": (["w_gvol", "g_par"], "SELECT w.dt, w.ticker, w.idx, w.k, 100 * r AS x, 100 * r - mu AS e, omega FROM w_gvol w JOIN g_par p ON p.epoch_idx = w.epoch_idx AND p.ticker = w.ticker"),
    "g_one": (["g_row"], "SELECT dt, ticker, any_value(omega) + 0.95 * sum(pow(0.94, k - 1) * pow(x - m, 2)) / sum(pow(0.94, k - 1)) AS h FROM (SELECT *, avg(x) OVER (PARTITION BY dt, ticker) AS m FROM g_row) WHERE k <= 75 GROUP BY 1, 2"),
    "g_fil": (["g_one", "g_row"], """SELECT g.dt, g.ticker, g.idx, g.k, g.e, g.omega, o.h, g.omega + 0.05 * g.e * g.e + 0.9 * o.h AS next_h FROM g_row g JOIN g_one o ON o.dt = g.dt AND o.ticker = g.ticker WHERE g.k = 1
  UNION ALL SELECT g.dt, g.ticker, g.idx, g.k, g.e, g.omega, f.next_h, g.omega + 0.05 * g.e * g.e + 0.9 * f.next_h FROM g_fil f JOIN g_row g ON g.dt = f.dt AND g.ticker = f.ticker AND g.k = f.k + 1"""),
    "g_vol": (["g_fil"], f"SELECT dt AS idx, ticker, sqrt((omega / 0.05 + (next_h - omega / 0.05) * (1 - pow(0.95, {C.horizon})) / (0.05 * {C.horizon})) / 1e4) * sqrt(252) AS vol FROM (SELECT dt, ticker, any_value(omega) AS omega, arg_max(next_h, k) AS next_h FROM g_fil GROUP BY 1, 2)"),
    "r_gvol": (["g_fil"], "SELECT dt, ticker, idx, e / sqrt(h) AS e FROM g_fil"),
    "s_gvol": (["x_gvol"], _sums("gvol", *_DCC_SUMS)),
    "gvol": (["pick", "g_vol"], "SELECT s.epoch_idx, s.exec_idx, s.ticker, passes, (1 / v.vol) / sum(1 / v.vol) OVER (PARTITION BY s.epoch_idx) AS weight FROM pick s JOIN g_vol v ON v.ticker = s.ticker AND v.idx = s.epoch_idx"),
    "g_routed": (["gvol"], """SELECT epoch_idx, exec_idx, ticker, weight FROM gvol WHERE passes
  UNION ALL SELECT epoch_idx, exec_idx, 'CASH', coalesce(sum(CASE WHEN NOT passes THEN weight END), 0) FROM gvol GROUP BY 1, 2"""),
    "sig_gvol": (["s_gvol", "gvol", "g_vol", "epochs"], _sigma("gvol", "g_vol")),
    "n_sig_gvol": (["sig_gvol"], _numbered("sig_gvol")),
    "f_sig_gvol": (["n_sig_gvol"], _band("sig_gvol")),
    "e_gvol": (["f_sig_gvol"], _fold("sig_gvol")),
    "t_full_garch_dcc": (["g_routed", "e_gvol"], _scaled("full_garch_dcc", "g_routed", "e_gvol")),
    "sig_ivol": (["s_ivol", "vol"], _sigma("ivol")),
    "sig_one": (["s_one", "vol"], _sigma("one")),
    "n_sig_ivol": (["sig_ivol"], _numbered("sig_ivol")),
    "n_sig_one": (["sig_one"], _numbered("sig_one")),
    "f_sig_ivol": (["n_sig_ivol"], _band("sig_ivol")),
    "f_sig_one": (["n_sig_one"], _band("sig_one")),
    "e_ivol": (["f_sig_ivol"], _fold("sig_ivol")),
    "e_one": (["f_sig_one"], _fold("sig_one")),
    "t_bh_market": (["clock"], f"SELECT 'bh_market' AS strategy_id, idx AS decision_idx, exec_idx, '{C.market}' AS ticker, 1.0 AS weight FROM clock WHERE idx = {WARM}"),
    "t_sixty_forty": (["clock"], f"SELECT 'sixty_forty' AS strategy_id, idx AS decision_idx, exec_idx, ticker, weight FROM clock, (VALUES ('{C.market}', 0.6), ('{C.bond}', 0.4)) v(ticker, weight) WHERE is_selection"),
    "t_ew_menu": (["clock", "panel"], f"SELECT 'ew_menu' AS strategy_id, c.idx AS decision_idx, c.exec_idx, p.ticker, 1.0 / count(*) OVER (PARTITION BY c.idx) AS weight FROM clock c JOIN panel p USING (idx) WHERE is_selection AND n >= {C.min_history}"),
    "t_mom_only": (["sel"], """SELECT 'mom_only' AS strategy_id, idx AS decision_idx, exec_idx, ticker, w AS weight FROM (SELECT *, 1.0 / count(*) OVER (PARTITION BY idx) AS w FROM sel) WHERE passes
  UNION ALL SELECT 'mom_only', idx, exec_idx, 'CASH', coalesce(sum(CASE WHEN NOT passes THEN w END), 0) FROM (SELECT *, 1.0 / count(*) OVER (PARTITION BY idx) AS w FROM sel) GROUP BY idx, exec_idx"""),
    "t_mom_ivol": (["routed"], "SELECT 'mom_ivol' AS strategy_id, epoch_idx AS decision_idx, exec_idx, ticker, weight FROM routed"),
    "t_voltarget_only": (["one", "e_one"], _scaled("voltarget_only", "one", "e_one")),
    "t_full": (["routed", "e_ivol"], _scaled("full", "routed", "e_ivol")),
}

BOOK = f"""
tg AS (SELECT strategy_id, exec_idx, ticker, CAST(weight AS DOUBLE) AS weight FROM targets WHERE exec_idx IS NOT NULL UNION ALL SELECT DISTINCT strategy_id, {WARM - 1}, 'CASH', 1.0::DOUBLE FROM targets),
seg AS (SELECT *, lead(exec_idx) OVER (PARTITION BY strategy_id ORDER BY exec_idx) AS next_idx FROM (SELECT DISTINCT strategy_id, exec_idx FROM tg)),
gr AS (SELECT ticker, idx, r FROM panel UNION ALL SELECT 'CASH', idx, rf FROM rf),
held0 AS (SELECT s.strategy_id, s.exec_idx, s.next_idx, g.idx, t.ticker, t.weight * product(1 + g.r) OVER (PARTITION BY s.strategy_id, s.exec_idx, t.ticker ORDER BY g.idx ROWS UNBOUNDED PRECEDING) AS value
  FROM seg s JOIN tg t ON t.strategy_id = s.strategy_id AND t.exec_idx = s.exec_idx JOIN gr g ON g.ticker = t.ticker AND g.idx > s.exec_idx AND (s.next_idx IS NULL OR g.idx <= s.next_idx)),
held AS (SELECT *, sum(value) OVER (PARTITION BY strategy_id, idx) AS total FROM held0),
trades AS (SELECT coalesce(b.strategy_id, t.strategy_id) AS strategy_id, coalesce(b.next_idx, t.exec_idx) AS exec_idx, coalesce(b.ticker, t.ticker) AS ticker, coalesce(b.value / b.total, 0) AS drifted_weight, coalesce(t.weight, 0) AS target_weight
  FROM (SELECT * FROM held WHERE idx = next_idx) b FULL JOIN (SELECT * FROM tg WHERE exec_idx >= {WARM}) t ON b.strategy_id = t.strategy_id AND b.next_idx = t.exec_idx AND b.ticker = t.ticker),
turn AS (SELECT strategy_id, exec_idx AS idx, sum(abs(target_weight - drifted_weight)) AS turnover FROM trades WHERE ticker <> 'CASH' GROUP BY 1, 2),
daily AS (SELECT d.*, coalesce(turnover, 0) AS turnover, 1 - coalesce(turnover, 0) * {C.bps} / 1e4 AS kept FROM (SELECT DISTINCT strategy_id, exec_idx, next_idx, idx, total FROM held) d LEFT JOIN turn USING (strategy_id, idx)),
car AS (SELECT s.strategy_id, s.exec_idx, coalesce(product(f.total * f.kept) OVER (PARTITION BY s.strategy_id ORDER BY s.exec_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS carried
  FROM seg s LEFT JOIN daily f ON f.strategy_id = s.strategy_id AND f.exec_idx = s.exec_idx AND f.idx = s.next_idx),
nav AS (SELECT strategy_id, idx, carried * total * kept AS nav, turnover, carried * total * (1 - kept) AS cost FROM daily JOIN car USING (strategy_id, exec_idx)),
wts AS (SELECT strategy_id, idx, ticker, value / total AS weight FROM held WHERE next_idx IS NULL OR idx < next_idx UNION ALL SELECT strategy_id, exec_idx, ticker, weight FROM tg WHERE exec_idx >= {WARM}),
dd AS (SELECT *, nav / max(nav) OVER (w ROWS UNBOUNDED PRECEDING) - 1 AS drawdown, nav / lag(nav) OVER w - 1 AS raw FROM nav WINDOW w AS (PARTITION BY strategy_id ORDER BY idx)),
ex AS (SELECT strategy_id, avg(e) AS average_exposure FROM (SELECT strategy_id, idx, sum(weight) AS e FROM wts WHERE ticker <> 'CASH' GROUP BY 1, 2) GROUP BY 1)"""

METRICS = """count(*) AS n_days, pow(max_by(nav, idx) / min_by(nav, idx), 252.0 / (count(*) - 1)) - 1 AS cagr, stddev_samp(raw) * sqrt(252) AS ann_vol,
  avg(coalesce(raw, 0) - rf) / stddev_samp(coalesce(raw, 0) - rf) * sqrt(252) AS sharpe,
  avg(coalesce(raw, 0) - rf) / stddev_samp(CASE WHEN coalesce(raw, 0) - rf < 0 THEN coalesce(raw, 0) - rf END) * sqrt(252) AS sortino,
  min(drawdown) AS max_drawdown, CASE WHEN min(drawdown) < 0 THEN (pow(max_by(nav, idx) / min_by(nav, idx), 252.0 / (count(*) - 1)) - 1) / abs(min(drawdown)) END AS calmar,
  sum(turnover) * 252 / count(*) AS turnover, sum(cost) / min_by(nav, idx) / count(*) * 252 * 1e4 AS cost_drag_bps"""


def ctes(names: list[str], done: list[str] | None = None) -> list[str]:
    done = [] if done is None else done
    for name in names:
        if name not in done:
            ctes(CTES[name][0], done)
            done.append(name)
    return done


def sql(body: str, names: list[str], extra: str = "") -> str:
    parts = [f"{n} AS ({CTES[n][1]})" for n in ctes(names)]
    if extra:
        parts.append(extra.strip())
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


def book_sql(body: str, strategies: list[str]) -> str:
    union = " UNION ALL ".join(f"SELECT strategy_id, decision_idx, exec_idx, ticker, weight FROM t_{s}" for s in strategies)
    return sql(body, ["panel", "rf", *(f"t_{s}" for s in strategies)], f"targets AS ({union}),{BOOK}")
