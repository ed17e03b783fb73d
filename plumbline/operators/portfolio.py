"""Weights, routing to cash, exposure with a hysteresis band, equal risk contributions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def inverse_vol(df: DataFrame, sigma: str, by: list[str]) -> DataFrame:
    bad = F.col(sigma).isNull() | (F.col(sigma) <= 0)
    inverse = F.when(bad, F.raise_error(F.lit("volatility must be positive"))).otherwise(1 / F.col(sigma))
    return df.withColumn("weight", inverse / F.sum(inverse).over(Window.partitionBy(*by)))


def equal_weight(df: DataFrame, by: list[str]) -> DataFrame:
    return df.withColumn("weight", F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy(*by)))


def route_to_cash(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, ticker, weight): assets that failed absolute momentum hand their weight to CASH; nothing is renormalised."""
    passed = df.where("passes").select(*by, "ticker", "weight")
    cash = df.groupBy(*by).agg(F.coalesce(F.sum(F.when(~F.coalesce("passes", F.lit(False)), F.col("weight"))), F.lit(0.0)).alias("weight"))
    return passed.unionByName(cash.select(*by, F.lit("CASH").alias("ticker"), "weight"))


def target_exposure(sigma_p: Column, sigma_star: Column, e_min: float) -> Column:
    return F.least(F.greatest(sigma_star / sigma_p, F.lit(e_min)), F.lit(1.0))


def banded(df: DataFrame, by: list[str], order: str, exposure: str, band: Column, mode: Column) -> DataFrame:
    """(by, order, exposure, applied, blocked): the first of an epoch is taken; later ones only when they leave the band
    around the one applied last. A fold over the epoch's few values. band and mode (absolute, log) are constants or columns
    of `by`."""
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("t"), F.col(exposure).alias("e")))).alias("xs"))

    def step(state: Column, x: Column) -> Column:
        gap = F.when(mode == "log", F.abs(F.ln(x["e"]) - F.ln(state["cur"]))).otherwise(F.abs(x["e"] - state["cur"]))
        take = state["cur"].isNull() | (gap > band)
        cur = F.when(take, x["e"]).otherwise(state["cur"])
        return F.struct(cur.alias("cur"), F.concat(state["out"], F.array(F.struct(x["t"].alias("t"), x["e"].alias("e"), cur.alias("applied"), (~take).alias("blocked")))).alias("out"))

    kind = df.schema[order].dataType.simpleString()
    empty = F.struct(F.lit(None).cast("double").alias("cur"), F.array().cast(f"array<struct<t:{kind},e:double,applied:double,blocked:boolean>>").alias("out"))
    out = rows.select(*by, F.explode(F.aggregate("xs", empty, step, lambda s: s["out"])).alias("x"))
    return out.select(*by, F.col("x.t").alias(order), F.col("x.e").alias(exposure), F.col("x.applied").alias("applied"), F.col("x.blocked").alias("blocked"))


def erc(cov: np.ndarray, tol: float = 1e-10, sweeps: int = 10_000) -> np.ndarray:
    """Equal risk contributions by cyclical coordinate descent: each weight solves its own quadratic in turn."""
    k = len(cov)
    x = 1 / np.sqrt(np.diag(cov))
    for _ in range(sweeps):
        old = x.copy()
        for i in range(k):
            cross = cov[i] @ x - cov[i, i] * x[i]
            x[i] = (-cross + np.sqrt(cross * cross + 4 * cov[i, i] / k)) / (2 * cov[i, i])
        if np.max(np.abs(x - old)) <= tol * np.max(np.abs(x)):
            return x / x.sum()
    raise ValueError("equal risk contributions did not converge")


#: Sweeps over the assets of a matrix; far more than the search takes, as what is left after them is an error.
SWEEPS = 100


def erc_weights(cov: DataFrame, by: str, sweeps: int = SWEEPS) -> DataFrame:
    """(by, ticker, weight) from long covariances (by, ticker_i, ticker_j, cov): the descent of erc as a fold over the assets
    of each group's matrix, which has as many rows as the group holds assets."""
    own = F.when(F.col("ticker_i") == F.col("ticker_j"), F.struct(F.col("ticker_i").alias("ticker"), (1 / F.sqrt("cov")).alias("x")))
    rows = cov.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("ticker_i", "ticker_j", "cov"))).alias("m"), F.array_sort(F.collect_list(own)).alias("own"))
    rows = rows.select(by, F.col("own.ticker").alias("tickers"), F.col("m.cov").alias("m"), F.size("own").alias("k"), F.col("own.x").alias("x"))
    m, k = F.col("m"), F.col("k")

    def row_sum(x: Column, i: Column) -> Column:
        return F.aggregate(F.transform(x, lambda v, j: v * F.get(m, i * k + j)), F.lit(0.0), lambda a, v: a + v)

    def step(x: Column, n: Column) -> Column:
        i = F.pmod(n, k)
        own = F.get(m, i * k + i)
        cross = row_sum(x, i) - own * F.get(x, i)
        return F.transform(x, lambda v, j: F.when(j == i, (-cross + F.sqrt(cross * cross + 4 * own / k)) / (2 * own)).otherwise(v))

    rows = rows.withColumn("x", F.aggregate(F.sequence(F.lit(0), sweeps * k - 1), F.col("x"), step))
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    off = F.array_max(F.transform("x", lambda v, i: F.abs(v * row_sum(F.col("x"), i) - 1 / k)))
    weights = F.when(off <= 1e-8, F.transform("x", lambda v: v / total)).otherwise(F.raise_error(F.lit("equal risk contributions did not converge")))
    return rows.select(by, F.inline(F.arrays_zip(F.col("tickers").alias("ticker"), weights.alias("weight"))))
