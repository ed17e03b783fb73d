"""Quality rules as a short-circuit cascade, built of DataFrame functions only.

A rule is a predicate that rejects a document. Each rule's cost, beyond that of a job without rules, and selectivity are
measured on a sample; the cascade then asks the rules in the order of rejections per second, and a document leaves at the
first that rejects it: the branches of one CASE expression are evaluated one after the other, so later rules cost nothing
for it. The order alters the time only, never a verdict.

Defined cases: null or blank text has no words and is rejected by `short`; a null verdict of a rule counts as passing;
an empty table gives an empty result in the rules' own order; extra columns are carried along, but for those
named rejected_by and kept, which are replaced (working columns carry the prefix __q_, which an input must not use).
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialize, release, words

#: Rows of the sample, about, that costs and selectivities are measured on.
SAMPLE_ROWS = 2_000

W, T = "__q_words", "__q_text"


def word_chars() -> Column:
    return F.char_length(F.array_join(F.col(W), "")).cast("long")


def n_words() -> Column:
    return F.size(W).cast("long")


def n_symbols() -> Column:
    return F.regexp_count(F.col(T), F.lit(r"[#*$%&|<>]")).cast("long")


def lines_with_words() -> Column:
    return F.filter(F.split(F.col(T), "\n"), lambda x: x.rlike(r"[^ \t-\r]"))


def n_dup_lines() -> Column:
    lines = lines_with_words()
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_repeat_words() -> Column:
    """Words inside 3-word windows that the text holds twice or more (windows are told apart by a 64-bit hash).

    Texts whose windows all differ stop at a hash-set count. For the others, sorted (hash, place) pairs give the places
    of repeated windows; put in order, each adds the words by which it passes the one before, three at most.
    """
    w = F.col(W)
    places = F.sequence(F.lit(1), F.size(w) - 2)
    keys = F.transform(places, lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))
    pairs = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

    def covered(ps: Column) -> Column:
        same = F.filter(ps, lambda p, i: (p["k"] == F.get(ps, i - 1)["k"]) | (p["k"] == F.get(ps, i + 1)["k"]).eqNullSafe(True))
        return same

    # the sorted array is bound once, as the only element of an array, so that the lambdas read it and do not rebuild it
    repeated = F.get(F.transform(F.array(pairs), covered), F.lit(0))
    starts = F.array_sort(F.transform(repeated, lambda p: p["i"]))
    total = F.get(F.transform(F.array(starts), lambda s: F.aggregate(F.transform(s, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(s, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)), F.lit(0))
    return F.when(F.size(w) < 4, 0).when(F.size(F.array_distinct(keys)) == F.size(w) - 2, 0).otherwise(total).cast("long")


def n_upper() -> Column:
    return F.regexp_count(F.col(T), F.lit(r"\p{Lu}")).cast("long")


def n_letters() -> Column:
    return F.regexp_count(F.col(T), F.lit(r"\p{L}")).cast("long")


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def default_rules() -> list[Rule]:
    """Published rules of thumb for web prose; thresholds are fixed values."""
    return [
        Rule("short", n_words() < 50),
        Rule("repeats", 100 * n_repeat_words() > 50 * n_words()),
        Rule("word_length", (word_chars() < 2 * n_words()) | (word_chars() > 14 * n_words())),
        Rule("symbols", 10 * n_symbols() > n_words()),
        Rule("dup_lines", 2 * n_dup_lines() > F.size(lines_with_words())),
        Rule("capitals", 2 * n_upper() > n_letters()),
    ]


def with_words(docs: DataFrame) -> DataFrame:
    # exploding the one-element array keeps Catalyst from pushing a filter on a verdict below the words, where every
    # lambda would split the text anew
    return docs.withColumn(T, F.coalesce(F.col("text"), F.lit(""))).withColumn(W, F.explode(F.array(words(F.col("text")))))


def measure(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(name, seconds, share rejected) of each rule over one sample of docs."""
    n = docs.count()
    sample = with_words(docs.sample(min(1.0, sample_rows / max(n, 1)), seed=7).select("text"))
    sample = materialize(sample.repartition(1), "quality-sample")

    def run(column: Column) -> tuple[float, float]:
        """(seconds, share): the best of three runs."""
        best, share = float("inf"), 0.0
        for _ in range(3):
            began = time.perf_counter()
            share = sample.agg(F.avg(column.cast("double"))).first()[0] or 0.0
            best = min(best, time.perf_counter() - began)
        return best, share

    nothing, _ = run(F.col(W).isNull())  # what a job costs that reads the words and asks no rule
    found = []
    for rule in rules:
        seconds, share = run(F.coalesce(rule.rejects, F.lit(False)))
        found.append((rule.name, max(seconds - nothing, 1e-4), share))
    release(sample)
    return found


def cascade_order(measured: list[tuple[str, float, float]]) -> list[str]:
    """Rules by rejections per second, greatest first; ties by name."""
    return [name for name, *_ in sorted(measured, key=lambda m: (-m[2] / max(m[1], 1e-6), m[0]))]


def first_rejecting(rules: list[Rule], order: list[str]) -> Column:
    """Name of the first rule, in this order, that rejects; null if none does."""
    by_name = {r.name: r for r in rules}
    out = F
    for name in order:
        out = out.when(F.coalesce(by_name[name].rejects, F.lit(False)), F.lit(name))
    return out


def quality_filter(docs: DataFrame, rules: list[Rule] | None = None, order: list[str] | None = None) -> DataFrame:
    """docs with rejected_by (null if kept) and kept, plus the working columns that with_words adds."""
    rules = default_rules() if rules is None else rules
    order = cascade_order(measure(docs, rules)) if order is None else order
    out = with_words(docs).withColumn("rejected_by", first_rejecting(rules, order))
    return out.withColumn("kept", F.col("rejected_by").isNull())


def drop_working(df: DataFrame) -> DataFrame:
    return df.drop(W, T)
