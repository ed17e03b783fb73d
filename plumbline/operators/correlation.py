"""Correlation and covariance on long pair tables (ticker_i, ticker_j); recursions are linear, hence weighted sums."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import decay
from plumbline.operators import matrices


def pairs(resid: DataFrame) -> DataFrame:
    """(idx, n, k, ticker_i, ticker_j, x, y) over the days on which every ticker has a residual; k counts them from 1."""
    tickers = resid.agg(F.count_distinct("ticker").alias("tickers"))
    days = resid.groupBy("idx").agg(F.count("e").alias("c")).join(F.broadcast(tickers)).where("c = tickers").select("idx")
    days = days.withColumn("k", F.row_number().over(Window.orderBy("idx"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    rows = resid.join(days, "idx")
    other = rows.select("idx", F.col("ticker").alias("ticker_j"), F.col("e").alias("y"))
    return rows.select("idx", "n", "k", F.col("ticker").alias("ticker_i"), F.col("e").alias("x")).join(other, "idx")


def q_bar(p: DataFrame, shrink: float) -> DataFrame:
    same = (F.col("ticker_i") == F.col("ticker_j")).cast("double")
    return p.groupBy("ticker_i", "ticker_j").agg(F.corr("x", "y").alias("c")).select("ticker_i", "ticker_j", ((1 - shrink) * F.col("c") + shrink * same).alias("q"))


def _normalised(s: DataFrame) -> DataFrame:
    """Unit diagonal; enough for sums of outer products, which have no negative eigenvalue."""
    d = s.where("ticker_i = ticker_j").select("ticker_i", F.col("s").alias("d"))
    out = s.join(d, "ticker_i").join(d.select(F.col("ticker_i").alias("ticker_j"), F.col("d").alias("e")), "ticker_j")
    return out.select("ticker_i", "ticker_j", F.when(F.col("ticker_i") == F.col("ticker_j"), 1.0).otherwise(F.col("s") / F.sqrt(F.col("d") * F.col("e"))).alias("corr"))


def ewma_corr(p: DataFrame, lam: float) -> DataFrame:
    """The last day's residual is not used, as in the recursion it replaces."""
    power = F.col("n") - 1 - F.col("k")
    term = F.when(power >= 0, (1 - lam) * F.pow(F.lit(lam), power) * F.col("x") * F.col("y"))
    seed: Column = F.covar_samp("x", "y") * F.pow(F.lit(lam), F.max("n") - 1)
    return _normalised(p.groupBy("ticker_i", "ticker_j").agg((seed + F.sum(term)).alias("s")))


def dcc_corr(p: DataFrame, a: float, b: float, shrink: float) -> DataFrame:
    """The correlation recursion with fixed (a, b) in closed form, started at and pulled to the shrunk mean."""
    power = F.col("n") - 1 - F.col("k")
    m = F.max("n") - 1
    fade = F.pow(F.lit(b), m)
    sums = p.groupBy("ticker_i", "ticker_j").agg((fade + (1 - a - b) * (1 - fade) / (1 - b)).alias("pull"), F.sum(F.when(power >= 0, a * F.pow(F.lit(b), power) * F.col("x") * F.col("y"))).alias("t"))
    q = sums.join(q_bar(p, shrink), ["ticker_i", "ticker_j"])
    return _normalised(q.select("ticker_i", "ticker_j", (F.col("pull") * F.col("q") + F.col("t")).alias("s")))


def covariance(corr: DataFrame, vol: DataFrame) -> DataFrame:
    """sigma_i * corr * sigma_j from (ticker, vol)."""
    i = vol.select(F.col("ticker").alias("ticker_i"), F.col("vol").alias("vi"))
    j = vol.select(F.col("ticker").alias("ticker_j"), F.col("vol").alias("vj"))
    return corr.join(i, "ticker_i").join(j, "ticker_j").select("ticker_i", "ticker_j", (F.col("vi") * F.col("corr") * F.col("vj")).alias("cov"))


def portfolio_vol(cov: DataFrame, weights: DataFrame) -> DataFrame:
    i = weights.select(F.col("ticker").alias("ticker_i"), F.col("weight").alias("wi"))
    j = weights.select(F.col("ticker").alias("ticker_j"), F.col("weight").alias("wj"))
    return cov.join(i, "ticker_i").join(j, "ticker_j").agg(F.sqrt(F.greatest(F.sum(F.col("wi") * F.col("cov") * F.col("wj")), F.lit(0.0))).alias("sigma_p"))


def shared_days(resid: DataFrame, decisions: DataFrame) -> DataFrame:
    """resid (idx, ticker, day, e) on the days that all tickers of a decision (idx, ticker) share, k counting these n days."""
    asked = decisions.select("idx", "ticker").distinct().groupBy("idx").agg(F.count(F.lit(1)).alias("tickers"))
    days = resid.groupBy("idx", "day").agg(F.count("e").alias("c")).join(asked, "idx").where("c = tickers")
    one = Window.partitionBy("idx")
    days = days.select("idx", "day", F.row_number().over(one.orderBy("day")).alias("k"), F.count(F.lit(1)).over(one).alias("n"))
    return resid.join(days, ["idx", "day"])


def corr_at(resid: DataFrame, decisions: DataFrame, lam: float, dcc: tuple[float, float] | None = None, shrink: float = 0.1) -> DataFrame:
    """(idx, ticker_i, ticker_j, corr) at each decision: exponentially weighted, or under the correlation recursion with (a, b)
    as given; the decision day's own residuals are not used."""
    rows = shared_days(resid, decisions)
    x = rows.select("idx", "day", "k", "n", F.col("ticker").alias("ticker_i"), F.col("e").alias("x"))
    y = rows.select("idx", "day", F.col("ticker").alias("ticker_j"), F.col("e").alias("y"))
    xy, power, m = x.join(y, ["idx", "day"]), F.col("n") - 1 - F.col("k"), F.max("n") - 1
    product = F.when(power >= 0, F.col("x") * F.col("y"))
    if dcc is None:
        s = F.pow(F.lit(lam), m) * F.covar_samp("x", "y") + F.coalesce(F.sum((1 - lam) * F.pow(F.lit(lam), power) * product), F.lit(0.0))
    else:
        a, b = dcc
        fade, same = F.pow(F.lit(b), m), F.max((F.col("ticker_i") == F.col("ticker_j")).cast("double"))
        pull = fade + (1 - a - b) * (1 - fade) / (1 - b)
        s = pull * ((1 - shrink) * F.corr("x", "y") + shrink * same) + F.coalesce(F.sum(a * F.pow(F.lit(b), power) * product), F.lit(0.0))
    s = xy.groupBy("idx", "ticker_i", "ticker_j").agg(s.alias("s"))
    own = Window.partitionBy("idx", "ticker_i"), Window.partitionBy("idx", "ticker_j")
    di, dj = (F.max(F.when(F.col("ticker_i") == F.col("ticker_j"), F.col("s"))).over(w) for w in own)
    corr = F.when(F.col("ticker_i") == F.col("ticker_j"), 1.0).otherwise(F.col("s") / F.sqrt(di * dj))
    return s.select("idx", "ticker_i", "ticker_j", corr.alias("corr"))


def sample_corr(p: DataFrame) -> DataFrame:
    return p.groupBy("ticker_i", "ticker_j").agg(F.corr("x", "y").alias("corr"))


def fresh(resid: DataFrame, decisions: DataFrame) -> DataFrame:
    """resid rows of the tickers decided on; an error where a ticker has no residual on its decision day (idx, ticker)."""
    here = decisions.join(resid.select("idx", "ticker", "e"), ["idx", "ticker"], "left")
    stale = F.when(F.col("e").isNull(), F.raise_error(F.concat(F.lit("stale residuals: "), "ticker"))).otherwise(F.col("e"))
    return here.withColumn("e", stale)


def projected(m: np.ndarray) -> np.ndarray:
    """What project does to one matrix, in numpy."""
    m = (m + m.T) / 2
    values, vectors = np.linalg.eigh(m)
    fixed = (vectors * np.maximum(values, 0)) @ vectors.T
    d = np.sqrt(np.diag(fixed))
    if not np.all(np.isfinite(d)) or d.min() <= 1e-12:
        raise ValueError("a variance collapsed to zero")
    out = fixed / np.outer(d, d)
    np.fill_diagonal(out, 1.0)
    return out


def pairwise_corr(rows: DataFrame, decisions: DataFrame, window: int, min_days: int) -> DataFrame:
    """(idx, ticker_i, ticker_j, n_days, corr) at each decision (idx, ticker), from values (ticker, idx, x) of the last `window`
    days, each pair on the days that both have. Fewer than min_days, or no variance, tell nothing: 0. Pairs differ in their
    days, so a matrix may be indefinite."""
    values = rows.select("ticker", F.col("idx").alias("day"), "x")
    at = decisions.select("idx", "ticker").distinct()
    # a day counts for the decisions of its own bucket of days and of the next one, so the join stays an equality
    bucket = lambda c: (F.col(c) / window).cast("long")
    near = values.select("*", F.explode(F.array(bucket("day"), bucket("day") + 1)).alias("bucket"))
    mine = at.withColumn("bucket", bucket("idx")).join(near, ["ticker", "bucket"]).where((F.col("day") <= F.col("idx")) & (F.col("day") > F.col("idx") - window))
    mine = mine.select("idx", "ticker", "day", "x")
    other = mine.select("idx", "day", F.col("ticker").alias("ticker_j"), F.col("x").alias("y"))
    both = mine.withColumnRenamed("ticker", "ticker_i").join(other, ["idx", "day"])
    told = (F.count(F.lit(1)) >= min_days) & (F.var_samp("x") > 0) & (F.var_samp("y") > 0)
    found = both.groupBy("idx", "ticker_i", "ticker_j").agg(F.count(F.lit(1)).alias("n_days"), F.when(told, F.corr("x", "y")).alias("corr"))
    places = at.withColumnRenamed("ticker", "ticker_i").join(at.withColumnRenamed("ticker", "ticker_j"), "idx")  # a decision's assets
    same = F.col("ticker_i") == F.col("ticker_j")
    corr = F.when(same, 1.0).otherwise(F.coalesce("corr", F.lit(0.0)))
    return places.join(found, ["idx", "ticker_i", "ticker_j"], "left").select("idx", "ticker_i", "ticker_j", F.coalesce("n_days", F.lit(0)).alias("n_days"), corr.alias("corr"))


def project(corr: DataFrame, by: str) -> DataFrame:
    """(by, ticker_i, ticker_j, corr): each group's matrix made a correlation matrix: mirrored, negative eigenvalues set to
    zero, unit diagonal. An error where a place is missing or a variance collapses."""
    rows = matrices.packed(corr, [by], "corr")
    return matrices.unpacked(rows, [by], matrices.unit_diagonal(rows["m"], rows["k"]), "corr")


def spectrum(corr: DataFrame, by: str) -> DataFrame:
    """(by, place, eigenvalue) of each group's matrix, ascending."""
    rows = matrices.packed(corr, [by], "corr")
    return rows.select(by, F.posexplode(F.array_sort(matrices.eigen(rows["m"], rows["k"])["values"])).alias("place", "eigenvalue")).withColumn("place", F.col("place") + 1)


#: Where the search for (a, b) starts, and the bound of their sum.
START, BOUND = (0.02, 0.95), 0.999


def dcc_path(e: np.ndarray, a: float, b: float, mean: np.ndarray) -> np.ndarray:
    """All Q: the mean first, then pulled by each day's residuals. The pull decays by b, so steps are taken in bulk."""
    n, k = e.shape
    push = a * np.einsum("ti,tj->tij", e[:-1], e[:-1]).reshape(n - 1, k * k) + ((1 - a - b) * mean).ravel()
    out = np.empty((n, k * k))
    out[0] = mean.ravel()
    for t in range(1, n):
        out[t] = push[t - 1] + b * out[t - 1]
    return out.reshape(n, k, k)


def dcc_loss(e: np.ndarray, a: float, b: float, mean: np.ndarray) -> float:
    """Correlation part of the negative quasi likelihood: sum of log |R| + e' R^-1 e."""
    if a < 0 or b < 0 or a + b >= BOUND:
        return float("inf")
    q = dcc_path(e, a, b, mean)
    d = np.sqrt(np.einsum("tii->ti", q))
    r = q / (d[:, :, None] * d[:, None, :])
    sign, logs = np.linalg.slogdet(r)
    if np.any(sign <= 0) or not np.all(np.isfinite(logs)):
        return float("inf")
    return float(logs.sum() + np.einsum("ti,ti->", e, np.linalg.solve(r, e[:, :, None])[:, :, 0]))


def estimate_dcc(e: np.ndarray, fixed: tuple[float, float], shrink: float) -> tuple[float, float, bool]:
    """(a, b, fell_back) by simplex search; the fixed pair where nothing can be estimated."""
    from plumbline.operators.volatility import minimise

    if len(e) < 2:
        return *fixed, True
    c = np.corrcoef(e, rowvar=False)
    if not np.all(np.isfinite(c)):
        raise ValueError("residuals without variance")
    mean = (1 - shrink) * np.atleast_2d(c) + shrink * np.eye(e.shape[1])
    free = lambda x: (BOUND / (1 + np.exp(-x[0])) / (1 + np.exp(-x[1])), BOUND / (1 + np.exp(-x[0])) * (1 - 1 / (1 + np.exp(-x[1]))))
    total, share = sum(START) / BOUND, START[0] / sum(START)
    x0 = np.array([np.log(total / (1 - total)), np.log(share / (1 - share))])
    a, b = free(minimise(lambda x: dcc_loss(e, *free(x), mean), x0, 200, 1e-9))
    if not (np.isfinite(a) and np.isfinite(b) and a + b < 1):
        return *fixed, True
    return float(a), float(b), False


def dcc_params(resid: DataFrame, by: str, fixed: tuple[float, float], shrink: float) -> DataFrame:
    """(by, a, b, fell_back) for each group's residuals (by, idx, ticker, e); days on which a ticker has none are left out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        e = pdf.pivot(index="idx", columns="ticker", values="e").dropna().sort_index().to_numpy()
        a, b, fell = estimate_dcc(e, fixed, shrink)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "a": [a], "b": [b], "fell_back": [fell]})

    return resid.groupBy(by).applyInPandas(run, f"{by} {resid.schema[by].dataType.simpleString()}, a double, b double, fell_back boolean")


def dcc_profile(resid: DataFrame, decisions: DataFrame, cells: list[tuple[float, float]], shrink: float) -> DataFrame:
    """(idx, a, b, n_days, loss, place): dcc_loss of every cell (a, b) at every decision (idx, ticker), lowest first, from
    residuals (idx, ticker, day, e) on the days that all its tickers share. The recursion is a decayed sum per pair, which
    depends on b alone; a day's matrix is then an array, which gives its loss for every a."""
    if odd := [c for c in cells if min(c) < 0 or sum(c) >= BOUND]:
        raise ValueError(f"cells out of range: {odd}")
    of_b = {b: [x for x, y in cells if y == b] for b in sorted({y for _, y in cells})}
    rows = shared_days(resid, decisions)
    x = rows.select("idx", "k", "n", F.col("ticker").alias("ticker_i"), F.col("e").alias("x"))
    y = rows.select("idx", "k", F.col("ticker").alias("ticker_j"), F.col("e").alias("y"))
    xy, pair = x.join(y, ["idx", "k"]), ["idx", "ticker_i", "ticker_j"]
    flat = F.when(F.col("var_x") > 0, F.col("c")).otherwise(F.raise_error(F.lit("residuals without variance")))
    same = (F.col("ticker_i") == F.col("ticker_j")).cast("double")
    mean = xy.groupBy(*pair).agg(F.var_samp("x").alias("var_x"), F.corr("x", "y").alias("c")).select(*pair, ((1 - shrink) * flat + shrink * same).alias("mean"))
    xy = xy.withColumn("b", F.explode(F.array(*map(F.lit, of_b))))
    sums = decay.with_decayed_sum(xy, F.col("b"), F.col("x") * F.col("y"), [*pair, "b"], "k", "s")
    before = F.coalesce(F.lag("s").over(Window.partitionBy(*pair, "b").orderBy("k")), F.lit(0.0))
    sums = sums.withColumn("before", before).join(mean, pair)
    own = F.when(F.col("ticker_i") == F.col("ticker_j"), F.struct("ticker_i", "x"))
    cell = F.struct("ticker_i", "ticker_j", "mean", "before")
    days = sums.groupBy("idx", "b", "k", "n").agg(F.array_sort(F.collect_list(cell)).alias("m"), F.array_sort(F.collect_list(own)).alias("e"))  # a day's matrix
    of = F.create_map(*(x for b, a in of_b.items() for x in (F.lit(b), F.array(*map(F.lit, a)))))
    days = days.withColumn("a", F.explode(of[F.col("b")]))
    fade = F.pow(F.col("b"), F.col("k") - 1)
    pull = fade + (1 - F.col("a") - F.col("b")) * (1 - fade) / (1 - F.col("b"))

    def unit(q: Column, k: Column) -> Column:
        of = lambda n: F.get(q, n * k + n)
        return F.transform(q, lambda v, n: v / F.sqrt(of((n / k).cast("int")) * of(F.pmod(n, k))))

    def loss(z: Column) -> Column:
        q = F.transform(z["m"], lambda c: z["pull"] * c["mean"] + z["a"] * c["before"])
        k, e = F.size(z["e"]), F.transform(z["e"], lambda v: v["x"])
        return matrices.let(q, lambda q: matrices.let(F.struct(unit(q, k).alias("r"), e.alias("e"), k.alias("k")), lambda r: matrices.quasi_loss(r["r"], r["e"], r["k"])))

    one = matrices.let(F.struct("m", "e", "a", pull.alias("pull")), loss)
    out = days.select("idx", "a", "b", "n", one.alias("loss")).groupBy("idx", "a", "b").agg(F.max("n").alias("n_days"), F.sum("loss").alias("loss"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("idx").orderBy("loss", "a", "b")))


def cadence(selections: DataFrame, every: int) -> DataFrame:
    """(epoch_idx, number, estimated, of_idx): parameters are estimated at every n-th selection (epoch_idx) and carried on
    to those that follow; of_idx is the selection that they come from."""
    w = Window.orderBy("epoch_idx")  # a row a selection
    out = selections.select("epoch_idx", F.row_number().over(w).alias("number")).withColumn("estimated", (F.col("number") - 1) % every == 0)
    of = F.last(F.when(F.col("estimated"), F.col("epoch_idx")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("of_idx", of)
