"""Exponentially decaying sums as window sums: S(k) = lam * S(k-1) + v(k), without a recursion and without overflow.

Weights are taken relative to blocks of so many steps that lam to their power is 1e-30: within a block they stay in range,
of the blocks before only the last still counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_steps(lam: Column) -> Column:
    return F.greatest(F.lit(1), F.coalesce(F.ceil(F.lit(30 * math.log(10)) / -F.ln(lam)), F.lit(1)))


def with_decayed_sum(rows: DataFrame, lam: float | Column, value: Column, by: list[str], k: str, name: str) -> DataFrame:
    """rows with `name`: the decayed sum of value up to and with each row. k numbers the rows of a group from 1; lam, from 0
    to below 1, is a constant or the same in all rows of a group."""
    base = F.lit(float(lam)) if isinstance(lam, float) else lam
    steps = block_steps(base)
    out = rows.withColumn("__steps", steps).withColumn("__v", value)
    out = out.withColumn("__block", F.floor((F.col(k) - 1) / F.col("__steps")).cast("long")).withColumn("__at", F.pmod(F.col(k) - 1, F.col("__steps")))
    here = Window.partitionBy(*by, "__block").orderBy(k).rowsBetween(Window.unboundedPreceding, 0)
    last = Window.partitionBy(*by).orderBy("__block").rangeBetween(-1, -1)
    at = F.col("__at")
    inside = F.pow(base, at) * F.sum(F.col("__v") * F.pow(base, -at)).over(here)
    carried = F.pow(base, at + 1) * F.coalesce(F.sum(F.col("__v") * F.pow(base, F.col("__steps") - 1 - at)).over(last), F.lit(0.0))
    return out.withColumn(name, inside + carried).drop("__block", "__v", "__at", "__steps")
