"""Volatility: rolling and exponentially weighted estimates as window sums, GARCH family by maximum likelihood.

EWMA variance is linear in squared returns, so it is a cumulative weighted sum: no recursion. The GARCH fit is the one
thing without a closed form; it runs for batches of (ticker, decision day) in numpy, on at most `window` returns each.
"""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import decay
from plumbline.operators import likelihood

DAYS = 252


def rolling_vol(panel: DataFrame, window: int) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(1 - window, 0)
    vol = F.when(F.count("r").over(w) == window, F.stddev_samp("r").over(w) * DAYS**0.5)
    return panel.withColumn("vol", vol)


def ewma(panel: DataFrame, lam: float) -> DataFrame:
    """variance after each return, over the whole past: lam^n h0 + (1 - lam) sum lam^(n-1-i) r_i^2, h0 the sample variance."""
    rows = panel.where("r is not null").withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy("date")))
    past = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = decay.with_decayed_sum(rows.withColumn("seed", F.var_samp("r").over(past)), lam, F.col("r") * F.col("r"), ["ticker"], "k", "squares")
    variance = F.pow(F.lit(lam), F.col("k")) * F.col("seed") + (1 - lam) * F.col("squares")
    return rows.withColumn("variance", variance).withColumn("vol", F.sqrt("variance") * DAYS**0.5).drop("squares")


def ewma_residuals(panel: DataFrame, lam: float) -> DataFrame:
    """Returns over the deviation expected before them, seeded by the sample variance of the ticker's whole series."""
    rows = panel.where("r is not null").withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy("date")))
    rows = decay.with_decayed_sum(rows, lam, F.col("r") * F.col("r"), ["ticker"], "k", "squares")
    before = (F.col("squares") - F.col("r") * F.col("r")) / lam
    seed = F.var_samp("r").over(Window.partitionBy("ticker"))
    variance = F.pow(F.lit(lam), F.col("k") - 1) * seed + (1 - lam) * F.greatest(before, F.lit(0.0))
    return rows.withColumn("variance", variance).withColumn("e", F.col("r") / F.sqrt("variance")).drop("squares")


def variance_path(scaled: np.ndarray, omega: float, alpha: float, beta: float, gamma: float, start: float) -> np.ndarray:
    added = omega + (alpha + gamma * (scaled < 0)) * scaled * scaled
    return np.array(list(accumulate(added.tolist(), lambda h, x: x + beta * h, initial=start)))


def minimise(f, x0: np.ndarray, steps: int = 1500, tol: float = 1e-8) -> np.ndarray:
    """Nelder-Mead simplex search."""
    n = len(x0)
    pts = [x0] + [x0 + np.eye(n)[i] * 0.4 for i in range(n)]
    vals = [f(p) for p in pts]
    for _ in range(steps):
        order = np.argsort(vals)
        pts, vals = [pts[i] for i in order], [vals[i] for i in order]
        if abs(vals[-1] - vals[0]) <= tol * (abs(vals[0]) + tol):
            break
        centre = np.mean(pts[:-1], axis=0)
        for scale in (1.0, 2.0):
            trial = centre + scale * (centre - pts[-1])
            v = f(trial)
            if scale == 1.0:
                first, v1 = trial, v
                if not v < vals[0]:
                    break
        best, vb = (trial, v) if scale == 2.0 and v < v1 else (first, v1)
        if vb < vals[-2]:
            pts[-1], vals[-1] = best, vb
            continue
        inside = centre + 0.5 * ((first if v1 < vals[-1] else pts[-1]) - centre)
        v = f(inside)
        if v < min(v1, vals[-1]):
            pts[-1], vals[-1] = inside, v
        else:
            pts = [pts[0]] + [pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]
            vals = [vals[0]] + [f(p) for p in pts[1:]]
    return pts[int(np.argmin(vals))]


def fit_garch(returns: np.ndarray, asymmetric: bool = False, min_obs: int = likelihood.MIN_OBS) -> dict[str, float]:
    """GARCH(1,1) (GJR if asymmetric) with Student-t errors, on returns times 100."""
    return likelihood.fit_garch_batch([returns], asymmetric, min_obs)[0]


def mean_forecast(next_variance: float, omega: float, persistence: float, horizon: int) -> float:
    """Mean of the analytic variance path over the horizon, in closed form."""
    if abs(1 - persistence) < 1e-12:
        return next_variance + omega * (horizon - 1) / 2
    level = omega / (1 - persistence)
    return level + (next_variance - level) * (1 - persistence**horizon) / ((1 - persistence) * horizon)


#: Series that one task fits together.
BATCH = 32
PARAMS = ("mu", "omega", "alpha", "beta", "gamma", "nu")
REFITS = "ticker string, idx int, mu double, omega double, alpha double, beta double, gamma double, nu double, fell_back boolean, reason string"


def in_windows(panel: DataFrame, decisions: DataFrame, window: int) -> DataFrame:
    """(ticker, at, idx, r): the last `window` returns up to each decision (ticker, idx). Days go in blocks of `window`; a
    window touches two of them, so the join meets at most twice the rows that it returns."""
    at = decisions.select("ticker", F.col("idx").cast("int").alias("at")).distinct()
    at = at.withColumn("block", F.explode(F.array(F.floor(F.col("at") / window), F.floor(F.col("at") / window) - 1)))
    returns = panel.where("r is not null").select("ticker", F.floor(F.col("idx") / window).alias("block"), "idx", "r")
    return at.join(returns, ["ticker", "block"]).where((F.col("idx") <= F.col("at")) & (F.col("idx") > F.col("at") - window)).select("ticker", "at", "idx", "r")


def residuals_at(panel: DataFrame, decisions: DataFrame, lam: float, window: int = 1000) -> DataFrame:
    """(idx, ticker, day, e): the residuals of the window that ends at each decision (ticker, idx), over the deviation expected
    before each return. The recursion is seeded by the sample variance of the window, so nothing after idx is used."""
    one = Window.partitionBy("ticker", "at")
    rows = in_windows(panel, decisions, window).withColumn("k", F.row_number().over(one.orderBy("idx"))).withColumn("seed", F.var_samp("r").over(one))
    rows = decay.with_decayed_sum(rows, lam, F.col("r") * F.col("r"), ["ticker", "at"], "k", "squares")
    before = F.greatest((F.col("squares") - F.col("r") * F.col("r")) / lam, F.lit(0.0))
    variance = F.pow(F.lit(lam), F.col("k") - 1) * F.col("seed") + (1 - lam) * before
    return rows.select(F.col("at").alias("idx"), "ticker", F.col("idx").alias("day"), (F.col("r") / F.sqrt(variance)).alias("e"))


def targeted(panel: DataFrame, decisions: DataFrame, alpha: float, beta: float, window: int = 1000) -> DataFrame:
    """Parameters at each decision (ticker, idx) by variance targeting: alpha and beta are given, the mean and the level come
    from the window's moments. A window without variance falls back."""
    rows = in_windows(panel, decisions, window).groupBy("ticker", F.col("at").alias("idx")).agg((100 * F.avg("r")).alias("mu"), (10_000 * F.var_pop("r")).alias("level"))
    given = {"alpha": alpha, "beta": beta, "gamma": 0.0, "nu": 8.0}
    omega = F.when(F.col("level") > 0, F.col("level") * (1 - alpha - beta))
    return rows.select("ticker", "idx", "mu", omega.alias("omega"), *(F.lit(v).alias(k) for k, v in given.items()), (~F.coalesce(F.col("level") > 0, F.lit(False))).alias("fell_back"))


def refit(panel: DataFrame, decisions: DataFrame, horizon: int, asymmetric: bool = False, window: int = 1000, record_errors: bool = False) -> DataFrame:
    """Parameters estimated at each decision (ticker, idx); fell_back with a reason where the fit is degenerate. A window with
    too few returns is an error, unless errors are recorded as reasons.

    Windows go to the tasks in batches of about BATCH by a hash of the decision; the series of a batch are fitted together.
    """
    decisions = decisions.select("ticker", "idx").distinct()
    batches = max(1, math.ceil(decisions.count() / BATCH))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = [(key, g.sort_values("idx")["r"].to_numpy()) for key, g in pdf.groupby(["ticker", "at"], sort=True)]
        enough = [len(r) >= likelihood.MIN_OBS or not record_errors for _, r in groups]
        fits = iter(likelihood.fit_garch_batch([r for (_, r), ok in zip(groups, enough, strict=True) if ok], asymmetric) if any(enough) else [])
        out = []
        for ((ticker, at), r), ok in zip(groups, enough, strict=True):
            row, reason = dict.fromkeys(PARAMS), f"{len(r)} returns; at least {likelihood.MIN_OBS} are needed"
            if ok:
                p = next(fits)
                variance = mean_forecast(p["next_variance"], p["omega"], persistence(p), horizon)
                reason = None if math.isfinite(variance) and variance > 0 and persistence(p) < 1 else "degenerate fit"
                row = row if reason else {k: p[k] for k in PARAMS}
            out.append({"ticker": ticker, "idx": int(at), **row, "fell_back": reason is not None, "reason": reason})
        return pd.DataFrame(out, columns=[c.split()[0] for c in REFITS.split(", ")])

    rows = in_windows(panel, decisions, window).withColumn("batch", F.pmod(F.xxhash64("ticker", "at"), F.lit(batches)))
    return rows.groupBy("batch").applyInPandas(fit, REFITS)


def persistence(p: dict[str, float]) -> float:
    return p["alpha"] + p["beta"] + p["gamma"] / 2


def filtered(panel: DataFrame, params: DataFrame, decisions: DataFrame, window: int = 1000) -> DataFrame:
    """(ticker, idx, k, e, h, next_h) of every return in the window of each decision (ticker, idx, of_idx), under the
    parameters of params at of_idx: h is expected before the return, next_h after it, in squared percent.

    With the parameters given the recursion is linear: h decays by beta, and what a return adds is known. So it is a
    decayed sum. It starts one step after the weighted mean square of the first 75 returns, the first weighing most.
    """
    asked = decisions.join(params.select("ticker", F.col("idx").alias("of_idx"), *PARAMS), ["ticker", "of_idx"]).where("omega is not null")
    rows = in_windows(panel, asked, window).join(asked.select("ticker", F.col("idx").alias("at"), *PARAMS), ["ticker", "at"])
    one = Window.partitionBy("ticker", "at")
    rows = rows.withColumn("k", F.row_number().over(one.orderBy("idx"))).withColumn("x", F.col("r") * 100).withColumn("e", F.col("x") - F.col("mu"))
    early = F.when(F.col("k") <= 75, F.pow(F.lit(0.94), F.col("k") - 1))
    centred = F.col("x") - F.avg("x").over(one)
    back = F.sum(early * centred * centred).over(one) / F.sum(early).over(one)
    rows = rows.withColumn("start", F.col("omega") + (F.col("alpha") + F.col("beta") + F.col("gamma") / 2) * back)
    added = F.col("omega") + (F.col("alpha") + F.when(F.col("e") < 0, F.col("gamma")).otherwise(0.0)) * F.col("e") * F.col("e")
    rows = decay.with_decayed_sum(rows.withColumn("added", added), F.col("beta"), F.col("added"), ["ticker", "at"], "k", "upto")
    rows = rows.withColumn("next_h", F.pow(F.col("beta"), F.col("k")) * F.col("start") + F.col("upto"))
    h = F.coalesce(F.lag("next_h").over(one.orderBy("idx")), F.col("start"))
    return rows.select("ticker", F.col("at").alias("idx"), F.col("idx").alias("day"), "k", "e", h.alias("h"), "next_h", "omega", "alpha", "beta", "gamma")


def forecast(next_h: str, horizon: int) -> Column:
    """Annualised volatility of the mean variance path over the horizon, from the filter's last state."""
    p = F.col("alpha") + F.col("beta") + F.col("gamma") / 2
    level = F.col("omega") / (1 - p)
    flat = F.col(next_h) + F.col("omega") * (horizon - 1) / 2
    mean = F.when(F.abs(1 - p) < 1e-12, flat).otherwise(level + (F.col(next_h) - level) * (1 - F.pow(p, F.lit(horizon))) / ((1 - p) * horizon))
    return F.sqrt(mean / 100**2) * DAYS**0.5


def filter_vol(panel: DataFrame, params: DataFrame, decisions: DataFrame, horizon: int, lam: float, window: int = 1000) -> DataFrame:
    """(ticker, idx, vol, fell_back) at each decision (ticker, idx, of_idx): parameters estimated at of_idx, the recursion
    run on to idx; where the estimate fell back, the exponentially weighted volatility."""
    return forecast_vol(panel, filtered(panel, params, decisions, window), decisions, horizon, lam)


def forecast_vol(panel: DataFrame, states: DataFrame, decisions: DataFrame, horizon: int, lam: float) -> DataFrame:
    """filter_vol from the filter's rows."""
    last = states.groupBy("ticker", "idx").agg(*(F.max_by(c, "day").alias(c) for c in ("next_h", "omega", "alpha", "beta", "gamma")))
    plain = ewma(panel, lam).select("ticker", "idx", F.col("vol").alias("plain"))
    rows = decisions.select("ticker", "idx").distinct().join(last.select("ticker", "idx", forecast("next_h", horizon).alias("vol")), ["ticker", "idx"], "left").join(plain, ["ticker", "idx"])
    return rows.select("ticker", "idx", F.coalesce("vol", "plain").alias("vol"), F.col("vol").isNull().alias("fell_back"))


def qlike(realized: str, forecast: str):
    ratio = F.col(realized) / F.col(forecast)
    return F.avg(F.when((F.col(realized) <= 0) | (F.col(forecast) <= 0), F.raise_error(F.lit("variances must be positive"))).otherwise(ratio - F.ln(ratio) - 1))


def walk_forward(panel: DataFrame, warmup: int, interval: int, horizon: int, lam: float) -> DataFrame:
    """(ticker, idx, forecast, realized): EWMA forecasts every `interval` returns against the mean square that follows."""
    rows = ewma(panel, lam)
    ahead = Window.partitionBy("ticker").orderBy("date").rowsBetween(1, horizon)
    r2 = F.col("r") * F.col("r")
    rows = rows.withColumn("realized", F.avg(r2).over(ahead)).withColumn("n_ahead", F.count("r").over(ahead))
    keep = (F.col("k") >= warmup) & ((F.col("k") - warmup) % interval == 0) & (F.col("n_ahead") == horizon)
    return rows.where(keep).select("ticker", "date", "idx", F.col("variance").alias("forecast"), "realized")
