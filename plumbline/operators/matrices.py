"""Small symmetric matrices as arrays of a row each, row by row, with folds for eigenvalues and determinants; no Python workers.

A group's matrix has as many rows as the group holds assets, so one array holds it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sweeps over all off-diagonal places; they converge quadratically, and what is left after them is an error.
SWEEPS = 12


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def packed(long: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, tickers, k, m) from (by, ticker_i, ticker_j, value): m has k * k values, mirrored where the two halves differ. An
    error where a place is missing or has no finite value."""
    rows = long.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ticker_i", "ticker_j", F.col(value).alias("v")))).alias("cells"))

    def mirrored(cells: Column) -> Column:
        return let(F.size(F.array_distinct(F.transform(cells, lambda c: c["ticker_i"]))), lambda k: of(cells, k))

    def of(cells: Column, k: Column) -> Column:
        whole = (F.size(cells) == k * k) & F.forall(cells, lambda c: F.coalesce(F.abs(c["v"]) < float("inf"), F.lit(False)))
        even = lambda c, n: (c["v"] + F.get(cells, F.pmod(n, k) * k + (n / k).cast("int"))["v"]) / 2
        return F.when(whole, F.transform(cells, even)).otherwise(F.raise_error(F.lit("a matrix with places missing")))

    tickers = F.array_distinct(F.transform("cells", lambda c: c["ticker_i"]))
    return rows.select(*by, tickers.alias("tickers"), F.size(tickers).alias("k"), let(F.col("cells"), mirrored).alias("m"))


def _rotated(state: Column, at: Column, k: Column) -> Column:
    """One Jacobi rotation that brings place (p, q) to zero; columns of a and v, then rows of a."""
    p, q, a = at["p"], at["q"], state["a"]
    off = F.get(a, p * k + q)
    theta = (F.get(a, q * k + q) - F.get(a, p * k + p)) / (2 * off)
    tan = F.when(F.abs(off) < 1e-300, 0.0).otherwise(F.when(theta >= 0, 1.0).otherwise(-1.0) / (F.abs(theta) + F.sqrt(theta * theta + 1)))
    turn = let(tan, lambda t: F.struct((1 / F.sqrt(t * t + 1)).alias("c"), (t / F.sqrt(t * t + 1)).alias("s")))

    def columns(x: Column, cs: Column) -> Column:
        def one(v: Column, n: Column) -> Column:
            j = F.pmod(n, k)
            return F.when(j == p, cs["c"] * v - cs["s"] * F.get(x, n + q - p)).when(j == q, cs["s"] * F.get(x, n - q + p) + cs["c"] * v).otherwise(v)

        return F.transform(x, one)

    def rows(x: Column, cs: Column) -> Column:
        def one(v: Column, n: Column) -> Column:
            i = (n / k).cast("int")
            return F.when(i == p, cs["c"] * v - cs["s"] * F.get(x, n + (q - p) * k)).when(i == q, cs["s"] * F.get(x, n - (q - p) * k) + cs["c"] * v).otherwise(v)

        return F.transform(x, one)

    return let(turn, lambda cs: F.struct(let(columns(a, cs), lambda b: rows(b, cs)).alias("a"), columns(state["v"], cs).alias("v")))


def eigen(m: Column, k: Column, sweeps: int = SWEEPS) -> Column:
    """(values, vectors) of a packed matrix: k values and k * k of the vectors, one a column, by cyclic Jacobi rotations over a
    fixed number of sweeps; an error where an off-diagonal value is left."""

    def of(x: Column) -> Column:
        k, m = x["k"], x["m"]
        until = F.sequence(F.lit(0), k - 1)
        diagonal = lambda n: F.pmod(n, k) == (n / k).cast("int")
        places = F.flatten(F.transform(until, lambda p: F.transform(F.filter(until, lambda q: q > p), lambda q: F.struct(p.alias("p"), q.alias("q")))))
        unit = F.transform(m, lambda _, n: F.when(diagonal(n), 1.0).otherwise(0.0))
        done = F.aggregate(F.flatten(F.array_repeat(places, sweeps)), F.struct(m.alias("a"), unit.alias("v")), lambda s, at: _rotated(s, at, k))

        def read(s: Column) -> Column:
            left = F.array_max(F.transform(s["a"], lambda v, n: F.when(diagonal(n), 0.0).otherwise(F.abs(v))))
            values = F.transform(until, lambda i: F.get(s["a"], i * k + i))
            right = left <= 1e-10 * F.array_max(F.transform(m, F.abs))
            return F.struct(F.when(right, values).otherwise(F.raise_error(F.lit("rotations did not converge"))).alias("values"), s["v"].alias("vectors"))

        return let(done, read)

    return let(F.struct(m.alias("m"), k.alias("k")), of)


def unit_diagonal(m: Column, k: Column) -> Column:
    """The nearest correlation of a kind to a packed matrix: negative eigenvalues set to zero, unit diagonal. An error where
    a variance collapses to zero."""

    def of(x: Column) -> Column:
        k, v = x["k"], x["vectors"]
        i, j = (lambda n: (n / k).cast("int")), (lambda n: F.pmod(n, k))

        def cell(kept: Column, n: Column) -> Column:
            return F.aggregate(F.transform(kept, lambda e, c: e * F.get(v, i(n) * k + c) * F.get(v, j(n) * k + c)), F.lit(0.0), lambda a, e: a + e)

        def scaled(y: Column) -> Column:
            return F.transform(y["m"], lambda c, n: F.when(i(n) == j(n), 1.0).otherwise(c / (F.get(y["d"], i(n)) * F.get(y["d"], j(n)))))

        def checked(m: Column) -> Column:
            d = F.transform(F.sequence(F.lit(0), k - 1), lambda c: F.sqrt(F.get(m, c * k + c)))
            whole = lambda d: F.when(F.array_min(d) > 1e-12, d).otherwise(F.raise_error(F.lit("a variance collapsed to zero")))
            return let(F.struct(m.alias("m"), let(d, whole).alias("d")), scaled)

        fixed = let(F.transform(x["values"], lambda e: F.greatest(e, F.lit(0.0))), lambda kept: F.transform(v, lambda _, n: cell(kept, n)))
        return let(fixed, checked)

    return let(eigen(m, k), lambda s: let(F.struct(s["values"].alias("values"), s["vectors"].alias("vectors"), k.alias("k")), of))


def unpacked(matrices: DataFrame, by: list[str], m: Column, name: str) -> DataFrame:
    """(by, ticker_i, ticker_j, name) of packed matrices."""
    cells = matrices.select(*by, "tickers", "k", F.posexplode(m).alias("n", name))
    i, j = (F.col("n") / F.col("k")).cast("int"), F.pmod(F.col("n"), F.col("k"))
    return cells.select(*by, F.get("tickers", i).alias("ticker_i"), F.get("tickers", j).alias("ticker_j"), name)


def quasi_loss(m: Column, e: Column, k: Column) -> Column:
    """log |m| + e' m^-1 e of a positive definite matrix and a vector, by symmetric elimination in k steps; infinite where a
    pivot is not positive."""

    def step(s: Column, i: Column) -> Column:
        pivot = F.get(s["m"], i * k + i)

        def cell(v: Column, n: Column) -> Column:
            return v - F.get(s["m"], (n / k).cast("int") * k + i) / pivot * F.get(s["m"], i * k + F.pmod(n, k))

        own = F.get(s["e"], i)
        rest = F.transform(s["m"], lambda v, n: F.when((n / k).cast("int") > i, cell(v, n)).otherwise(v))
        e_rest = F.transform(s["e"], lambda v, j: F.when(j > i, v - F.get(s["m"], j * k + i) / pivot * own).otherwise(v))
        loss = F.when(pivot > 0, s["loss"] + F.ln(pivot) + own * own / pivot).otherwise(float("inf"))
        return F.struct(rest.alias("m"), e_rest.alias("e"), loss.alias("loss"))

    start = F.struct(m.alias("m"), e.alias("e"), F.lit(0.0).alias("loss"))
    return F.aggregate(F.sequence(F.lit(0), k - 1), start, step, lambda s: s["loss"])
