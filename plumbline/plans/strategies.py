"""Strategies as target tables (strategy_id, decision_idx, exec_idx, ticker, weight) and their backtest."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators import backtest, correlation, portfolio, signals, volatility
from plumbline.operators.signals import Config
from plumbline.sources import market
from plumbline.sources.tables import cut

NAMES = ("bh_market", "ew_menu", "sixty_forty", "mom_only", "mom_ivol", "voltarget_only", "full", "full_erc", "full_gjr", "full_garch", "full_garch_dcc")
#: Alpha and beta under variance targeting, and (a, b) of the fixed correlation recursion.
TARGETED, DCC = (0.05, 0.9), (0.01, 0.96)
COLUMNS = ["strategy_id", "decision_idx", "exec_idx", "ticker", "weight"]


class Study:
    """One panel and its derived tables. Tables that several plans read are written once, so that no plan nests another's."""

    def __init__(self, spark: SparkSession, d: str, cfg: Config | None = None, until: int | None = None) -> None:
        """until: the last day (idx) that this study may see."""
        self.spark, self.cfg = spark, cfg or Config()
        panel = market.panel(spark, d)
        self.panel = cut(panel if until is None else panel.where(F.col("idx") <= until), "panel")
        self.rf = cut(market.cash_rate(self.panel, market.rates(spark, d)), "rf", 1)
        self.warmup = max(self.cfg.lookback + 1, self.cfg.min_history)
        self.last_idx = self.panel.agg(F.max("idx")).first()[0]
        self.clock = cut(signals.clock(self.rf, self.cfg, self.warmup), "clock", 1)
        self._made: dict[str, DataFrame] = {}

    def once(self, name: str, make: Callable[[], DataFrame], partitions: int | None = None) -> DataFrame:
        """A table that several plans read."""
        if name not in self._made:
            self._made[name] = cut(make(), name, partitions)
        return self._made[name]

    @property
    def selection(self) -> DataFrame:
        return self.once("selection", lambda: signals.selection(self.panel, self.rf, self.cfg, self.warmup))

    @property
    def vol(self) -> DataFrame:
        """(ticker, idx, vol): EWMA volatility after each return."""
        return self.once("vol", lambda: volatility.ewma(self.panel, self.cfg.lam).select("ticker", "idx", "vol"))

    @property
    def resid(self) -> DataFrame:
        return self.once("resid", lambda: volatility.ewma_residuals(self.panel, self.cfg.lam).select("ticker", "idx", "e"))

    def epochs(self) -> DataFrame:
        """(epoch_idx, idx, exec_idx): each decision day with the selection day that governs it."""
        w = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
        days = self.clock.where("is_selection or is_check")
        return days.withColumn("epoch_idx", F.last(F.when(F.col("is_selection"), F.col("idx")), True).over(w)).select("epoch_idx", "idx", "exec_idx")

    def targets(self, name: str) -> DataFrame:
        made = getattr(self, f"_{name}")()
        return made.select(F.lit(name).alias("strategy_id"), "decision_idx", "exec_idx", "ticker", "weight")

    def _days(self) -> DataFrame:
        return self.clock.where("is_selection").select(F.col("idx").alias("decision_idx"), "exec_idx")

    def _bh_market(self) -> DataFrame:
        return self._days().where(F.col("decision_idx") == self.warmup).select("*", F.lit(self.cfg.market).alias("ticker"), F.lit(1.0).alias("weight"))

    def _sixty_forty(self) -> DataFrame:
        mix = F.array(F.struct(F.lit(self.cfg.market).alias("ticker"), F.lit(0.6).alias("weight")), F.struct(F.lit(self.cfg.bond).alias("ticker"), F.lit(0.4).alias("weight")))
        return self._days().select("*", F.inline(mix))

    def _ew_menu(self) -> DataFrame:
        held = signals.eligible(self.panel, self.cfg).select(F.col("idx").alias("decision_idx"), "ticker").join(self._days(), "decision_idx")
        return portfolio.equal_weight(held, ["decision_idx"])

    def _selected(self) -> DataFrame:
        return self.selection.select(F.col("idx").alias("decision_idx"), "exec_idx", "ticker", "passes")

    def _mom_only(self) -> DataFrame:
        return portfolio.route_to_cash(portfolio.equal_weight(self._selected(), ["decision_idx"]), ["decision_idx", "exec_idx"])

    def _risky(self) -> DataFrame:
        vol = self.vol.select(F.col("idx").alias("decision_idx"), "ticker", "vol")
        return portfolio.inverse_vol(self._selected().join(vol, ["decision_idx", "ticker"]), "vol", ["decision_idx"])

    def _mom_ivol(self) -> DataFrame:
        return portfolio.route_to_cash(self._risky(), ["decision_idx", "exec_idx"])

    def residuals(self, decisions: DataFrame) -> DataFrame:
        """(idx, ticker, day, e): EWMA residuals known at each decision (idx, ticker)."""
        return cut(volatility.residuals_at(self.panel, decisions, self.cfg.lam), "residuals")

    def covariances(self, decisions: DataFrame, vol: DataFrame | None = None, resid: DataFrame | None = None, dcc: tuple[float, float] | None = None) -> DataFrame:
        """(idx, ticker_i, ticker_j, corr, cov) at each decision (idx, ticker), from the residuals known then, on the days that
        all tickers of the decision share. resid: (idx, ticker, day, e), else EWMA residuals; dcc: (a, b), else EWMA."""
        at = cut(decisions.select("idx", "ticker").distinct(), "asked")
        s = correlation.corr_at(self.residuals(at) if resid is None else resid.join(at, ["idx", "ticker"], "left_semi"), at, self.cfg.lam, dcc)
        v = (self.vol if vol is None else vol).select("idx", "ticker", "vol")
        s = s.join(v.select("idx", F.col("ticker").alias("ticker_i"), F.col("vol").alias("vi")), ["idx", "ticker_i"]).join(v.select("idx", F.col("ticker").alias("ticker_j"), F.col("vol").alias("vj")), ["idx", "ticker_j"])
        return s.select("idx", "ticker_i", "ticker_j", "corr", (F.col("vi") * F.col("corr") * F.col("vj")).alias("cov"))

    def sigmas(self, risky: DataFrame, vol: DataFrame | None = None, resid: DataFrame | None = None, dcc: tuple[float, float] | None = None) -> DataFrame:
        """(epoch_idx, idx, exec_idx, sigma_p) at every decision, from weights of each epoch (epoch_idx, ticker, weight)."""
        rows = cut(self.epochs().join(risky.select("epoch_idx", "ticker", "weight"), "epoch_idx"), "risky")
        cov = self.covariances(rows, vol, resid, dcc)
        wi = rows.select("epoch_idx", "idx", "exec_idx", F.col("ticker").alias("ticker_i"), F.col("weight").alias("wi"))
        wj = rows.select("idx", F.col("ticker").alias("ticker_j"), F.col("weight").alias("wj"))
        s = cov.join(wi, ["idx", "ticker_i"]).join(wj, ["idx", "ticker_j"])
        s = s.groupBy("epoch_idx", "idx", "exec_idx").agg(F.sqrt(F.greatest(F.sum(F.col("wi") * F.col("cov") * F.col("wj")), F.lit(0.0))).alias("sigma_p"))
        return cut(s, "sigma")

    def exposures(self, risky: DataFrame, vol: DataFrame | None = None, resid: DataFrame | None = None, dcc: tuple[float, float] | None = None) -> DataFrame:
        """(epoch_idx, idx, exec_idx, sigma_p, exposure, applied, blocked) from weights of each epoch."""
        return self._banded(self.sigmas(risky, vol, resid, dcc))

    def _banded(self, s: DataFrame) -> DataFrame:
        s = s.withColumn("exposure", portfolio.target_exposure(F.col("sigma_p"), F.lit(self.cfg.sigma_star), self.cfg.e_min))
        fold = portfolio.banded(s, ["epoch_idx"], "idx", "exposure", F.lit(self.cfg.band), F.lit(self.cfg.band_mode))
        return cut(s.join(fold.select("epoch_idx", "idx", "applied", "blocked"), ["epoch_idx", "idx"]), "exposures")

    def grid(self, sigma: DataFrame, cells: DataFrame) -> DataFrame:
        """(cell, epoch_idx, idx, exec_idx, exposure, applied, blocked): the exposures of sigma (epoch_idx, idx, exec_idx,
        sigma_p) under the settings of every cell (cell, sigma_star, band, band_mode); cells are few rows."""
        s = sigma.crossJoin(F.broadcast(cells))
        s = s.withColumn("exposure", portfolio.target_exposure(F.col("sigma_p"), F.col("sigma_star"), self.cfg.e_min))
        by = ["cell", "epoch_idx", "band", "band_mode"]
        fold = portfolio.banded(s, by, "idx", "exposure", F.col("band"), F.col("band_mode"))
        return cut(s.join(fold.select("cell", "epoch_idx", "idx", "applied", "blocked"), ["cell", "epoch_idx", "idx"]), "grid")

    def _scaled(self, routed: DataFrame, exposures: DataFrame) -> DataFrame:
        """Targets of the decisions that the band lets through: risky weights times exposure, the rest in cash."""
        taken = exposures.where("not blocked").select("epoch_idx", F.col("idx").alias("decision_idx"), "exec_idx", "applied")
        rows = routed.where(F.col("ticker") != backtest.CASH).select("epoch_idx", "ticker", "weight").join(taken, "epoch_idx")
        rows = rows.select("decision_idx", "exec_idx", "ticker", (F.col("weight") * F.col("applied")).alias("weight"))
        held = rows.groupBy("decision_idx").agg(F.sum("weight").alias("held"))
        cash = taken.join(held, "decision_idx", "left").select("decision_idx", "exec_idx", F.lit(backtest.CASH).alias("ticker"), (1 - F.coalesce("held", F.lit(0.0))).alias("weight"))
        return rows.unionByName(cash)

    def _voltarget_only(self) -> DataFrame:
        one = self._days().select(F.col("decision_idx").alias("epoch_idx"), F.lit(self.cfg.market).alias("ticker"), F.lit(1.0).alias("weight"))
        return self._scaled(one, self.exposures(one))

    def _full(self) -> DataFrame:
        risky = self._risky().withColumnRenamed("decision_idx", "epoch_idx")
        return self._scaled(portfolio.route_to_cash(risky, ["epoch_idx"]), self.exposures(risky))

    def _full_erc(self) -> DataFrame:
        chosen = self._selected().withColumnRenamed("decision_idx", "epoch_idx")
        cov = self.covariances(chosen.select(F.col("epoch_idx").alias("idx"), "ticker"))
        weights = portfolio.erc_weights(cov.withColumn("epoch_idx", F.col("idx").cast("int")), "epoch_idx")
        risky = chosen.select("epoch_idx", "ticker", "passes").join(weights, ["epoch_idx", "ticker"])
        return self._scaled(portfolio.route_to_cash(risky, ["epoch_idx"]), self.exposures(risky))

    def refit_days(self) -> DataFrame:
        """(ticker, idx, of_idx): the selected tickers on every decision day, parameters being those of the selection day."""
        chosen = self._selected().select(F.col("decision_idx").alias("epoch_idx"), "ticker")
        return self.once("refit_days", lambda: self.epochs().join(chosen, "epoch_idx").select("ticker", "idx", F.col("epoch_idx").alias("of_idx")).distinct())

    def fits(self, asymmetric: bool = False) -> DataFrame:
        """Parameters by maximum likelihood at every selection; selections before there are enough weekly returns fall back."""
        days = self.refit_days().where("idx = of_idx")
        return self.once(f"fits-{asymmetric}", lambda: volatility.refit(self.panel, days, self.cfg.horizon, asymmetric, record_errors=True))

    def filtered(self, name: str, params: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(vol, resid) at every decision day: params are re-estimated on selection days only, between them the filter runs on
        with those of the epoch. Where no parameters could be estimated, both are exponentially weighted."""
        days = self.refit_days()
        states = self.once(f"states-{name}", lambda: volatility.filtered(self.panel, params, days))
        vol = self.once(f"vol-{name}", lambda: volatility.forecast_vol(self.panel, states, days, self.cfg.horizon, self.cfg.lam))
        resid = states.select("idx", "ticker", "day", (F.col("e") / F.sqrt("h")).alias("e"))
        plain = vol.where("fell_back").select("idx", "ticker")
        resid = self.once(f"resid-{name}", lambda: resid.unionByName(volatility.residuals_at(self.panel, plain, self.cfg.lam)))
        return vol.select("ticker", "idx", "vol"), resid

    def _refitted(self, name: str, params: DataFrame, dcc: tuple[float, float] | None = None) -> DataFrame:
        vol, resid = self.filtered(name, params)
        chosen = self._selected().withColumnRenamed("decision_idx", "epoch_idx")
        priced = chosen.join(vol.withColumnRenamed("idx", "epoch_idx"), ["epoch_idx", "ticker"])
        risky = portfolio.inverse_vol(priced, "vol", ["epoch_idx"])
        return self._scaled(portfolio.route_to_cash(risky, ["epoch_idx"]), self.exposures(risky, vol, resid, dcc))

    def _full_gjr(self) -> DataFrame:
        return self._refitted("gjr", self.fits(True))

    def _full_garch(self) -> DataFrame:
        return self._refitted("garch", self.fits())

    def _full_garch_dcc(self) -> DataFrame:
        """GARCH by variance targeting at each selection, correlations by the recursion with fixed (a, b)."""
        days = self.refit_days().where("idx = of_idx")
        params = self.once("targeted", lambda: volatility.targeted(self.panel, days, *TARGETED))
        return self._refitted("targeted", params, DCC)

    def book(self, *names: str) -> backtest.Book:
        targets = reduce(DataFrame.unionByName, map(self.targets, names))
        return self.book_of(self.once("targets-" + "-".join(names), lambda: targets))

    def book_of(self, targets: DataFrame) -> backtest.Book:
        return backtest.run(targets, self.panel, self.rf, self.warmup, self.last_idx, self.cfg.bps)


def cell_reason() -> Column:
    """Why a cell (sigma_star, band, band_mode) of a parameter grid cannot run; null where it can."""
    return (
        F.when(~F.coalesce(F.col("sigma_star") > 0, F.lit(False)), "risk.sigma_star must be positive")
        .when(~F.coalesce(F.col("band") >= 0, F.lit(False)), "risk.exposure_band must not be negative")
        .when(~F.coalesce(F.col("band_mode").isin("absolute", "log"), F.lit(False)), F.concat(F.lit("unknown risk.exposure_band_mode: "), F.coalesce("band_mode", F.lit("null"))))
    )


#: Strategies whose exposure depends on a cell's settings, and the weights that they scale.
SCALED = {"voltarget_only": lambda s: s._days().select(F.col("decision_idx").alias("epoch_idx"), F.lit(s.cfg.market).alias("ticker"), F.lit(1.0).alias("weight")), "full": lambda s: s._risky().withColumnRenamed("decision_idx", "epoch_idx")}


def grid_book(s: Study, strategy: str, cells: DataFrame) -> tuple[DataFrame, backtest.Book]:
    """(cells with their reason, book) of grid_targets."""
    judged, targets = grid_targets(s, strategy, cells)
    return judged, s.book_of(cut(targets, "targets-grid"))


def grid_targets(s: Study, strategy: str, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells with their reason, targets): every valid cell (cell, sigma_star, band, band_mode) of a strategy, told apart by
    strategy_id; a cell that cannot run is a row with a reason and does not stop the others. An unknown strategy is an error."""
    if strategy not in SCALED:
        raise ValueError(f"unknown strategy for a grid: {strategy!r}; known: {', '.join(SCALED)}")
    judged = cut(cells.withColumn("reason", cell_reason()), "cells", 1)
    risky = SCALED[strategy](s)
    routed = portfolio.route_to_cash(risky, ["epoch_idx"]) if "passes" in risky.columns else risky
    taken = s.grid(s.sigmas(risky), judged.where("reason is null").drop("reason")).where("not blocked").select("cell", "epoch_idx", F.col("idx").alias("decision_idx"), "exec_idx", "applied")
    rows = routed.where(F.col("ticker") != backtest.CASH).select("epoch_idx", "ticker", "weight").join(taken, "epoch_idx")
    rows = rows.select(F.col("cell").alias("strategy_id"), "decision_idx", "exec_idx", "ticker", (F.col("weight") * F.col("applied")).alias("weight"))
    held = rows.groupBy("strategy_id", "decision_idx").agg(F.sum("weight").alias("held"))
    days = taken.select(F.col("cell").alias("strategy_id"), "decision_idx", "exec_idx")
    cash = days.join(held, ["strategy_id", "decision_idx"], "left").select("strategy_id", "decision_idx", "exec_idx", F.lit(backtest.CASH).alias("ticker"), (1 - F.coalesce("held", F.lit(0.0))).alias("weight"))
    return judged, rows.unionByName(cash)


def look_ahead(spark: SparkSession, d: str, names: tuple[str, ...], until: int | None = None, tol: float = 1e-9) -> DataFrame:
    """(strategy_id, compared, differing): targets up to a day of a study that has all prices against those of a study that
    ends on that day; targets that only one of them has differ. until: the day, else half way from the warm-up to the end.
    tol: for weights; likelihood fits add up in the order of their batch, so weights from them agree to about 1e-6."""
    whole = Study(spark, d)
    until = whole.warmup + (whole.last_idx - whole.warmup) // 2 if until is None else until
    ends = Study(spark, d, until=until)
    key = ["strategy_id", "decision_idx", "ticker"]

    def targets(s: Study) -> DataFrame:
        made = reduce(DataFrame.unionByName, map(s.targets, names))
        return cut(made.where(F.col("decision_idx") <= until).select(*key, "weight"), "targets-until")

    both = targets(whole).join(targets(ends).withColumnRenamed("weight", "again"), key, "full")
    same = F.coalesce(F.abs(F.col("weight") - F.col("again")) <= tol, F.lit(False))
    return both.groupBy("strategy_id").agg(F.count("weight").alias("compared"), F.count_if(~same).alias("differing"))
