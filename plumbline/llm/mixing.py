"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words: its weight's share of the whole, at most CAP times what it has, the excess shared
again by weight until none is above. Within a source a document's expected copies are in proportion to its inclusion
weight, by default its size class (binary digits of its number of words, so fragments are repeated less than long texts),
with a factor that makes the expected words equal the target, and at most CAP. The whole part of them is certain. The rest
is an inclusion probability p, and an order sample decides on it: documents are ranked by their random odds u / (1 - u)
over their inclusion odds p / (1 - p) and taken from the front until the words taken are nearest to what the certain
copies leave. The random number comes from a digest of doc_id and the seed, so reruns agree.

The ranking is cut without sorting a source in one task: words are summed in 4096 rank bins a source, the bin holding the
cut is split into 4096 finer bins, and only the documents of the finer bin are put in order.

Defined cases: null text has size 0 and takes nothing; null sources form one source, ranked last; a source without words
takes nothing; rows that repeat doc_id and size fall on the same side of the cut; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import materialize, words

#: Weights of the sources in order of name, repeating, and the most copies of a document.
WEIGHTS = (5, 2, 1)
CAP = 3
BINS = 4096
#: Inclusion weights are whole numbers from 1 to this.
MOST_WEIGHT = 1000


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) from 52 bits of a digest of the key; a null key counts as an empty one."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target from source, source_size. One row a source: this table is small beside documents."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("weight", weight.cast("long")).withColumn("full", F.col("source_size") * cap)
    order = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(every))
    s = s.withColumn("left_words", F.col("total") - F.coalesce(F.sum("full").over(before), F.lit(0)))
    s = s.withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("level", F.col("left_words").cast("double") / F.col("left_weight").cast("double"))
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("full"), F.struct(F.col("full") / F.col("weight"), "level"))).over(every)["level"])
    share = F.col("level") * F.col("weight").cast("double")
    return s.select("source", "source_size", F.coalesce(F.least(share, F.col("full").cast("double")), F.lit(0.0)).alias("target"))


def size_class(size: Column) -> Column:
    """Binary digits of a document's number of words, 1 at least."""
    return F.length(F.bin(F.greatest(size, F.lit(1))))


def expected_copies(classes: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, weight, whole, p, need) from classes (source, target, weight, words): the certain copies and the inclusion
    probability of a document of this weight, and the words of the source that the sample is to bring.

    Copies are factor * weight, at most cap; the factor comes from the heaviest classes down: those that reach the cap are
    set, the others share what is left. A source has at most MOST_WEIGHT rows here.
    """
    heavier = Window.partitionBy("source").orderBy(F.desc("weight")).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy("source").orderBy(F.desc("weight")).rowsBetween(0, Window.unboundedFollowing)
    left = F.col("target") - F.lit(float(cap)) * F.coalesce(F.sum("words").over(heavier), F.lit(0)).cast("double")
    c = classes.withColumn("factor", F.try_divide(left, F.sum(F.col("words") * F.col("weight")).over(rest).cast("double")))
    fits = F.col("factor") * F.col("weight") <= cap
    factor = F.max_by(F.when(fits, F.col("factor")), F.when(fits, F.col("weight"))).over(Window.partitionBy("source"))
    copies = F.when(F.col("target") > 0, F.least(F.coalesce(factor * F.col("weight"), F.lit(float(cap))), F.lit(float(cap)))).otherwise(0.0)
    c = c.withColumn("copies", copies).withColumn("whole", F.floor("copies"))
    need = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(Window.partitionBy("source")).cast("double")
    return c.select("source", "weight", "whole", (F.col("copies") - F.col("whole").cast("double")).alias("p"), need.alias("need"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = "mix", inclusion: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs.

    `inclusion`: a column of docs with a document's inclusion weight, a whole number from 1 to MOST_WEIGHT (others are set
    to the nearest); by default its size class.
    """
    size = F.size(words(F.col("text"))).cast("long")
    weight = size_class(F.col("size")) if inclusion is None else F.greatest(F.lit(1), F.least(F.lit(MOST_WEIGHT), F.coalesce("given", F.lit(1))))
    base = docs.select(F.col("doc_id"), F.col("source"), size.alias("size"), (F.lit(1) if inclusion is None else inclusion).cast("int").alias("given"))
    base = materialize(base.select("doc_id", "source", "size", weight.cast("int").alias("weight")), "mix-sizes")
    classes = materialize(base.groupBy("source", "weight").agg(F.sum("size").alias("words")), "mix-classes")
    sources = materialize(source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap), "mix-targets")

    aimed = classes.join(sources.withColumnRenamed("source", "of_source"), F.col("source").eqNullSafe(F.col("of_source")))
    s = expected_copies(aimed.select("source", "target", "weight", "words"), cap).withColumnsRenamed({"source": "of_source", "weight": "of_weight"})
    s = s.join(sources, F.col("of_source").eqNullSafe(F.col("source"))).drop("source")
    s = materialize(s, "mix-copies")
    u = uniform(F.col("doc_id"), seed)
    q = u / (1 - u) * (1 - F.col("p")) / F.col("p")
    rank = F.when(F.col("p") > 0, q / (1 + q))  # null: nothing to decide
    same = F.col("source").eqNullSafe(F.col("of_source")) & (F.col("weight") == F.col("of_weight"))
    rows = base.join(s, same).drop("of_source", "of_weight").withColumn("rank", rank)
    fine = F.col("rank") * BINS
    rows = rows.withColumn("bin", F.floor(fine).cast("int")).withColumn("sub", F.floor((fine - F.floor(fine)) * BINS).cast("int"))

    def cut(df: DataFrame, by: str, start: Column) -> DataFrame:
        """The bin of each source in which the words taken pass the need, and the words before it."""
        sums = df.groupBy("source", "need", by, start.alias("start")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy(by)) + F.col("start")
        sums = sums.withColumn("upto", upto)
        return sums.where("upto >= need and upto - words < need").select(F.col("source").alias("cut_source"), F.col(by).alias(f"cut_{by}"), (F.col("upto") - F.col("words")).alias("before"))

    unsure = rows.where("rank is not null")
    first = materialize(cut(unsure, "bin", F.lit(0).cast("long")), "mix-cut")
    inside = unsure.join(first, F.col("source").eqNullSafe(F.col("cut_source")) & (F.col("bin") == F.col("cut_bin")))
    second = cut(inside, "sub", F.col("before")).withColumnsRenamed({"cut_source": "sub_source", "before": "sub_before"})
    close = inside.join(second, F.col("source").eqNullSafe(F.col("sub_source")) & (F.col("sub") == F.col("cut_sub")))
    order = Window.partitionBy("source").orderBy("rank", "doc_id", "size")
    upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("sub_before")
    key = F.struct("rank", "doc_id", "size")
    close = close.withColumn("in", upto - F.col("size") / 2 <= F.col("need"))
    last = close.groupBy("source", "cut_bin", "cut_sub").agg(F.max(F.when(F.col("in"), key)).alias("last")).withColumnRenamed("source", "last_source")

    limits = sources.select(F.col("source").alias("limit_source"))
    limits = limits.join(first, F.col("limit_source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source", "before", "cut_bin")
    limits = limits.join(last, F.col("limit_source").eqNullSafe(F.col("last_source")), "left").drop("last_source")
    limits = materialize(limits, "mix-limits")

    edge = (F.col("cut_bin") < F.col("bin")) | ((F.col("cut_bin") == F.col("bin")) & (F.col("cut_sub") <= F.col("sub")))
    chosen = F.when((F.col("need") <= 0) | F.col("rank").isNull(), False).when(F.col("cut_bin").isNull(), True).when(F.col("last").isNull(), ~edge).otherwise(key <= F.col("last"))
    out = rows.join(limits, F.col("source").eqNullSafe(F.col("limit_source")))
    copies = F.col("whole") + chosen.cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
