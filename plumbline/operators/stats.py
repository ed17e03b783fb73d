"""Resampling and multiple-testing statistics. Repetitions are rows that Spark spreads; their random numbers come from
digests of (seed, kind, repetition, place), so reruns agree and no state is carried."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators import metrics

DAYS = 252
METRICS = ("sharpe", "calmar", "max_drawdown")


def uniform(seed: int, kind: str, *parts: str) -> Column:
    """A number in (0, 1) from 52 bits of a digest."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}:{kind}"), *(F.col(p).cast("string") for p in parts))), 1, 13), 16, 10)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def _places(spark: SparkSession, n: int, reps: int) -> DataFrame:
    return spark.range(reps).select(F.col("id").cast("int").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("t"))


def bootstrap_days(spark: SparkSession, n: int, reps: int, mean_block: float, seed: int) -> DataFrame:
    """(rep, t, at): stationary bootstrap of n days, blocks of geometric length, wrapped around."""
    fresh = (F.col("t") == 0) | (uniform(seed, "f", "rep", "t") < 1 / mean_block)
    rows = _places(spark, n, reps).withColumn("from", F.when(fresh, F.col("t"))).withColumn("start", F.when(fresh, F.floor(uniform(seed, "s", "rep", "t") * n).cast("int")))
    w = Window.partitionBy("rep").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    at = F.pmod(F.last("start", True).over(w) + F.col("t") - F.last("from", True).over(w), F.lit(n))
    return rows.select("rep", "t", at.alias("at"))


def swapped_days(spark: SparkSession, n: int, reps: int, mean_block: float, seed: int) -> DataFrame:
    """(rep, t, swap): blocks of geometric length, each swapped or not by a fair draw."""
    w = Window.partitionBy("rep").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    rows = _places(spark, n, reps).withColumn("block", F.sum((uniform(seed, "p", "rep", "t") < 1 / mean_block).cast("int")).over(w))
    return rows.select("rep", "t", (uniform(seed, "w", "rep", "block") < 0.5).alias("swap"))


def numbered(returns: DataFrame) -> DataFrame:
    """returns (strategy_id, idx, ret, excess) of the days that every strategy has, numbered t = 0, 1, ..."""
    strategies = returns.agg(F.count_distinct("strategy_id").alias("k"))
    days = returns.groupBy("idx").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(strategies)).where("c = k")
    days = days.select("idx", (F.row_number().over(Window.orderBy("idx")) - 1).alias("t"))  # trading days
    return returns.join(days, "idx").select("strategy_id", "t", "ret", "excess")


def aligned(returns: DataFrame) -> DataFrame:
    """The same rows; an error where strategies differ in their number of days."""
    n = returns.groupBy("strategy_id").agg(F.count(F.lit(1)).alias("c")).agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    text = F.concat(F.lit("strategies differ in their number of days: "), F.col("lo").cast("string"), F.lit(" to "), F.col("hi").cast("string"))
    same = F.when(F.col("lo") < F.col("hi"), F.raise_error(text).cast("boolean")).otherwise(True)
    return returns.join(F.broadcast(n.select(same.alias("same"))), F.col("same")).drop("same")


def sample_metrics(sample: DataFrame, by: list[str]) -> DataFrame:
    """METRICS of each series (by, t, ret, excess); the net asset value starts at 1 before the first day."""
    w = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    rows = sample.withColumn("nav", F.exp(F.sum(F.log1p("ret")).over(w)))
    rows = rows.withColumn("fall", F.col("nav") / F.greatest(F.lit(1.0), F.max("nav").over(w)) - 1)
    cagr = F.pow(F.max_by("nav", "t"), F.lit(float(DAYS)) / F.count(F.lit(1))) - 1
    fall = F.min("fall")
    return rows.groupBy(*by).agg(metrics.sharpe(F.col("excess")).alias("sharpe"), F.when(fall < 0, cagr / F.abs(fall)).alias("calmar"), fall.alias("max_drawdown"))


def long_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, metric, value)."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS))
    return df.select(*by, F.inline(pairs))


def bootstrap(returns: DataFrame, reps: int, mean_block: float, seed: int) -> DataFrame:
    """(rep, strategy_id, metric, value) of all strategies on the same resampled days. returns: (strategy_id, t, ret, excess)."""
    n = returns.agg(F.max("t")).first()[0] + 1
    days = bootstrap_days(returns.sparkSession, n, reps, mean_block, seed)
    sample = days.join(F.broadcast(returns.withColumnRenamed("t", "at")), "at").drop("at")  # trading days of a few strategies
    return long_metrics(sample_metrics(sample, ["rep", "strategy_id"]), ["rep", "strategy_id"])


def pair_differences(values: DataFrame, pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, metric, left, right, diff) for pairs (left, right) of strategies from values (by, strategy_id, metric, value)."""
    a = values.select(*by, "metric", F.col("strategy_id").alias("left"), F.col("value").alias("x"))
    b = values.select(*by, "metric", F.col("strategy_id").alias("right"), F.col("value").alias("y"))
    return F.broadcast(pairs).join(a, "left").join(b, [*by, "metric", "right"]).select(*by, "metric", "left", "right", (F.col("x") - F.col("y")).alias("diff"))


def permutation(returns: DataFrame, pairs: DataFrame, reps: int, mean_block: float, seed: int) -> DataFrame:
    """(rep, metric, left, right, diff): differences after swapping the two series of each pair in random blocks."""
    n = returns.agg(F.max("t")).first()[0] + 1
    days = swapped_days(returns.sparkSession, n, reps, mean_block, seed)
    a = returns.select("t", F.col("strategy_id").alias("left"), F.struct("ret", "excess").alias("a"))
    b = returns.select("t", F.col("strategy_id").alias("right"), F.struct("ret", "excess").alias("b"))
    both = F.broadcast(pairs.join(a, "left").join(b, ["t", "right"]))  # trading days of a few pairs
    rows = days.join(both, "t")
    sides = F.array(F.struct(F.lit("l").alias("side"), F.when(F.col("swap"), F.col("b")).otherwise(F.col("a")).alias("v")), F.struct(F.lit("r").alias("side"), F.when(F.col("swap"), F.col("a")).otherwise(F.col("b")).alias("v")))
    rows = rows.select("rep", "t", "left", "right", F.inline(sides)).select("rep", "t", "left", "right", "side", "v.ret", "v.excess")
    by = ["rep", "left", "right", "side"]
    values = long_metrics(sample_metrics(rows, by), by)
    l, r = (F.max(F.when(F.col("side") == s, F.col("value"))) for s in "lr")
    return values.groupBy("rep", "metric", "left", "right").agg((l - r).alias("diff"))


def interval(value: str, alpha: float) -> list[Column]:
    """Aggregates lo, hi, excludes_zero of the finite values: percentiles with linear interpolation."""
    x = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value))
    lo, hi = F.percentile(x, F.lit(alpha / 2)), F.percentile(x, F.lit(1 - alpha / 2))
    return [lo.alias("lo"), hi.alias("hi"), ((lo > 0) | (hi < 0)).alias("excludes_zero")]


def p_values(draws: DataFrame, observed: DataFrame) -> DataFrame:
    """(metric, left, right, p_value): two-sided, the observed difference counted as one draw."""
    rows = draws.join(F.broadcast(observed.withColumnRenamed("diff", "point")), ["metric", "left", "right"])
    beyond = F.count(F.when(F.abs("diff") >= F.abs("point") - 1e-12, 1))
    return rows.groupBy("metric", "left", "right").agg(((beyond + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))


#: A rational approximation of the normal distribution function to double precision, its numerator and
#: denominator, and where a continued fraction takes over.
CDF_UP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
CDF_DOWN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
CDF_FAR, ROOT_2PI = 7.07106781186547, 2.506628274631


def normal_cdf(x: Column) -> Column:
    a = F.abs(x)
    near = F.exp(-a * a / 2) * _poly(CDF_UP, a) / _poly(CDF_DOWN, a)
    far = F.exp(-a * a / 2) / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / ROOT_2PI
    below = F.when(a < CDF_FAR, near).otherwise(far)
    return F.when(x > 0, 1 - below).otherwise(below)


def psr(sr: Column, n: Column, skew: Column, kurt: Column, benchmark: Column) -> Column:
    """Probability that the true per-period Sharpe ratio exceeds the benchmark; kurt is not the excess."""
    return normal_cdf((sr - benchmark) * F.sqrt(n - 1) / F.sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr))


def max_quantile(trials: int) -> float:
    """The expected maximum of so many standard normal numbers, about."""
    nd, gamma = NormalDist(), 0.5772156649015329
    return (1 - gamma) * nd.inv_cdf(1 - 1 / trials) + gamma * nd.inv_cdf(1 - 1 / (trials * math.e))


def expected_max_sharpe(variance: Column, trials: int) -> Column:
    return F.sqrt(variance) * max_quantile(trials)


def moments(returns: DataFrame, of: str = "ret") -> DataFrame:
    """(strategy_id, n, sr, skew, kurt) of per-period returns: population skewness and kurtosis, not excess."""
    return returns.groupBy("strategy_id").agg(F.count(of).alias("n"), F.try_divide(F.avg(of), F.stddev_samp(of)).alias("sr"), F.skewness(of).alias("skew"), (F.kurtosis(of) + 3).alias("kurt"))


def overfitting(returns: DataFrame, blocks: int) -> DataFrame:
    """(combo, best, omega, logit) for every choice of half the blocks as the training sample, from sums per block only.
    combo has a bit for each block of the training sample. Sums go by day, then by block: ratios that are equal but for
    rounding rank alike in every run."""
    ends = returns.agg(F.count_distinct("idx").alias("days"), F.min("idx").alias("first"))
    rows = returns.join(F.broadcast(ends)).withColumn("block", F.floor((F.col("idx") - F.col("first")) / F.floor(F.col("days") / blocks)).cast("int")).where(F.col("block") < blocks)
    so_far = Window.partitionBy("strategy_id", "block").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("strategy_id", "block", "idx", F.count("ret").over(so_far).alias("n"), F.sum("ret").over(so_far).alias("s"), F.sum(F.col("ret") * F.col("ret")).over(so_far).alias("q"))
    sums = rows.groupBy("strategy_id", "block").agg(*(F.max_by(c, "idx").alias(c) for c in "nsq"))
    sums = sums.groupBy("strategy_id").agg(F.array_sort(F.collect_list(F.struct("block", *"nsq"))).alias("sums"))  # one row a block
    chosen = returns.sparkSession.range(1 << blocks).select(F.col("id").alias("combo")).where(F.bit_count("combo") == blocks // 2)
    split = chosen.join(F.broadcast(sums))

    def ratio(inside: bool) -> Column:
        here = F.filter("sums", lambda b: F.getbit("combo", b["block"]) == F.lit(int(inside)))

        def total(c: str) -> Column:
            return F.aggregate(here, F.lit(0.0), lambda a, b: a + F.coalesce(b[c], F.lit(0.0)))

        n, s, q = map(total, "nsq")
        return F.try_divide(F.try_divide(s, n), F.sqrt(F.greatest(F.try_divide(q - F.try_divide(s * s, n), n - 1), F.lit(0.0))))

    low = F.lit(float("-inf"))
    perf = split.select("combo", "strategy_id", F.coalesce(ratio(True), low).alias("train"), F.coalesce(ratio(False), low).alias("test"))
    per = Window.partitionBy("combo")
    rank = F.rank().over(per.orderBy("test"))
    first_best = F.row_number().over(per.orderBy(F.desc("train"), "strategy_id"))
    out = perf.select("combo", "strategy_id", rank.alias("rank"), F.count(F.lit(1)).over(per).alias("k"), first_best.alias("pick")).where("pick = 1")
    omega = F.col("rank") / (F.col("k") + 1)
    return out.select("combo", F.col("strategy_id").alias("best"), omega.alias("omega"), F.ln(omega / (1 - omega)).alias("logit"))


def pareto_front(points: DataFrame, x: str, y: str) -> DataFrame:
    """Points no other beats on both; both are minimised. Equal points, up to rounding, stay or go together."""
    order = Window.orderBy(x)
    below = F.lag(x).over(order)
    rows = points.withColumn("step", F.when(below.isNull() | (F.col(x) - below > metrics.TINY), 1).otherwise(0))
    rows = rows.withColumn("level", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))  # points of one x
    least = F.min(y).over(Window.partitionBy("level"))
    best = F.min(y).over(Window.orderBy("level").rangeBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("least", least).withColumn("best", best).where(F.col(y) - F.col("least") <= metrics.TINY)
    return rows.where(F.col("best").isNull() | (F.col(y) < F.col("best") - metrics.TINY)).drop("step", "level", "least", "best")


def autocorrelation(series: DataFrame, by: str, value: str, lags: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy("idx")
    x = series.where(F.col(value).isNotNull()).withColumn("x", F.col(value) - F.avg(value).over(Window.partitionBy(by)))
    x = x.select(by, "idx", "x", *(F.lag("x", k).over(w).alias(f"l{k}") for k in range(1, lags + 1)))
    sums = x.groupBy(by).agg(*(F.coalesce(F.sum(F.col("x") * F.col(f"l{k}")), F.lit(0.0)).alias(f"l{k}") for k in range(1, lags + 1)), F.sum(F.col("x") * F.col("x")).alias("q"))
    return sums.select(by, F.posexplode(F.array(*(F.col(f"l{k}") / F.col("q") for k in range(1, lags + 1)))).alias("pos", "acf")).select(by, (F.col("pos") + 1).alias("lag"), "acf")


#: Coefficients of a rational approximation of the normal quantile, relative error below 1.2e-9.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
_TAIL = 0.02425


def _poly(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    q = p - 0.5
    low, high = F.sqrt(-2 * F.ln(p)), F.sqrt(-2 * F.ln(1 - p))
    middle = q * _poly(_A, q * q) / _poly(_B, q * q)
    return F.when(p < _TAIL, _poly(_C, low) / _poly(_D, low)).when(p > 1 - _TAIL, -_poly(_C, high) / _poly(_D, high)).otherwise(middle)


def quantile_pairs(series: DataFrame, by: str, value: str) -> DataFrame:
    """(by, k, theory, value): ordered values against normal quantiles at (k - 1/2) / n."""
    rows = series.where(F.col(value).isNotNull()).withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy(value, "idx")))
    p = (F.col("k") - 0.5) / F.count(F.lit(1)).over(Window.partitionBy(by))
    return rows.select(by, "k", normal_quantile(p).alias("theory"), value)


def dominates(front: DataFrame, other: DataFrame, x: str, y: str) -> DataFrame:
    """(dominates): whether each point of other is met by one of front that is no worse on both. Curves of a few points."""
    a = front.select(F.col(x).alias("ax"), F.col(y).alias("ay"))
    beaten = other.join(a, (F.col("ax") <= F.col(x) + 1e-12) & (F.col("ay") <= F.col(y) + 1e-12), "left_anti")
    return beaten.agg((F.count(F.lit(1)) == 0).alias("dominates"))


def nearest_pair(a: DataFrame, b: DataFrame, by: str, x: str) -> DataFrame:
    """(by, a, b, gap): the pair of structs of the two sides whose x lie nearest; ties by the order of a, then b."""
    left, right = a.select(by, F.struct(*a.columns).alias("a")), b.select(by, F.struct(*b.columns).alias("b"))
    rows = left.join(right, by).withColumn("gap", F.abs(F.col(f"a.{x}") - F.col(f"b.{x}")))
    first = F.row_number().over(Window.partitionBy(by).orderBy("gap", "a", "b"))
    return rows.withColumn("first", first).where("first = 1").drop("first")
