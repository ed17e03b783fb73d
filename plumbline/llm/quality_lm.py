"""Quality classifier: interpolated modified Kneser-Ney n-gram model of trusted text, perplexity per document, thresholds
by language.

The model's units are UTF-8 bytes, its order is ORDER; an n-gram is a whole number of at most 40 bits, so nothing is hashed.
Counts of trusted texts form by partial aggregation; continuation counts, the three discounts of each order, back-off
weights and interpolated probabilities follow by grouping and joining count tables, order by order.

Scoring joins all documents with the table in shards: an n-gram and the contexts it may back off through share their last
but one byte, so the table is cut by that byte into shards of about SHARD_ROWS rows, every position of every text belongs
to one shard, and each shard is joined on the map side (its size is bounded) in a pass over the texts. Sums by document add
the shards up. Texts themselves are never shuffled and are read whole.

A document is kept when its mean log10 probability per byte is not below that of its language's limit: the QUANTILE of the
trusted documents of that language less MARGIN; languages without trusted documents take the limit of all trusted.

Defined cases: null or empty text has perplexity null and is not kept; rows that repeat are judged alike; null lang is a
language of its own; without trusted text everything non-empty is kept; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import shingles
from plumbline.llm.common import bounded_broadcast, materialize

ORDER = 5
SHARD_ROWS = 1_000_000
#: Labelled documents that are learned from, about; they are chosen by language and a digest of doc_id. Limits come from all.
TRUSTED_DOCS = 50_000
QUANTILE, MARGIN = 0.002, 0.1
START = 0  # byte before a text's first


def _grams(column: pa.Array, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-grams ending at each byte, row of each) of about SLICE bytes; texts are padded in front by START bytes."""
    data, offs = shingles.string_bytes(column)
    row, n, pad = 0, len(offs) - 1, order - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(offs, offs[row] + shingles.SLICE, "right")) - 1)
        if last == row + 1:
            text = data[offs[row] : offs[last]]
            for at in range(0, len(text), shingles.SLICE):
                part = np.concatenate([np.full(max(0, pad - at), START, np.uint8), text[max(0, at - pad) : at + shingles.SLICE]])
                grams = _join(part, order)
                yield grams, np.full(len(grams), row)
        else:
            lengths = np.diff(offs[row : last + 1])
            owner = np.repeat(np.arange(last - row), lengths)
            out = np.full(offs[last] - offs[row] + pad * (last - row), START, np.uint8)
            at = np.arange(len(owner)) + pad * (owner + 1)
            out[at] = data[offs[row] : offs[last]]
            yield _join(out, order)[at - pad], owner + row
        row = last


def _join(data: np.ndarray, order: int) -> np.ndarray:
    """The n-gram ending at byte i, for i = order - 1 .. len - 1."""
    wide = data.astype(np.uint64)
    m = max(len(data) - order + 1, 0)
    out = np.zeros(m, np.uint64)
    for j in range(order):
        out = out << np.uint64(8) | wide[j : j + m]
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        grams, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n)], ["gram", "c"])

    for batch in batches:
        for grams, _ in _grams(batch.column(0), ORDER):
            held.append(grams)
            if len(held) >= 16:
                yield flush()
    if held:
        yield flush()


def kneser_ney(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(order, gram, logp) of every n-gram and (order, gram, logb) of every context, from counts (gram, c) of order ORDER."""
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))
        levels[k] = materialize(levels[k + 1].groupBy(suffix.alias("gram")).agg(F.count(F.lit(1)).alias("c")), f"kn-{k}")
    lower = counts.sparkSession.range(256).select(F.col("id").alias("last"), F.lit(1 / 256).cast("double").alias("q"))
    grams = contexts = None
    for k in range(1, ORDER + 1):
        at = levels[k]
        n = at.agg(*(F.sum((F.col("c") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4))).first()
        n1, n2, n3, n4 = (max(float(n[f"n{i}"] or 0), 1.0) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = [min(max(x, 0.05), m - 0.05) for x, m in ((1 - 2 * y * n2 / n1, 1), (2 - 3 * y * n3 / n2, 2), (3 - 4 * y * n4 / n3, 3))]
        discount = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        context = F.shiftright("gram", 8)
        seen = at.groupBy(context.alias("context")).agg(F.sum("c").alias("total"), F.sum(discount).alias("cut"))
        rest = F.col("gram").bitwiseAND(F.lit((1 << 8 * max(k - 1, 1)) - 1)).alias("last")
        p = at.select("gram", "c", context.alias("context"), rest, discount.alias("d")).join(seen, "context").join(lower, "last")
        p = p.select("gram", ((F.col("c") - F.col("d")) / F.col("total") + F.col("cut") / F.col("total") * F.col("q")).alias("q"))
        p = materialize(p, f"kn-p{k}")
        lower = p.withColumnRenamed("gram", "last")
        g = p.select(F.lit(k).alias("order"), "gram", F.log10("q").alias("value"))
        c = seen.select(F.lit(k).alias("order"), F.col("context").alias("gram"), F.log10(F.col("cut") / F.col("total")).alias("value"))
        grams = g if grams is None else grams.unionByName(g)
        contexts = c if contexts is None else contexts.unionByName(c)
    return materialize(grams, "kn-grams"), materialize(contexts, "kn-contexts")


class _Table:
    """Lookup of ascending whole numbers: one probe of a hashed table answers most, a binary search the rest."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.values = keys, values
        self.shift = np.uint64(64 - max(8, int(np.ceil(np.log2(2 * len(keys) + 2)))))
        self.slots = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        self.slots[self._slot(self.keys)] = np.arange(len(keys))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value) of each key."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
        at = self.slots[self._slot(keys)]
        found = (at >= 0) & (self.keys[at] == keys)
        unsure = np.flatnonzero((at >= 0) & ~found)
        if len(unsure):
            place = np.minimum(np.searchsorted(self.keys, keys[unsure]), len(self.keys) - 1)
            hit = self.keys[place] == keys[unsure]
            at[unsure[hit]] = place[hit]
            found[unsure[hit]] = True
        return found, np.where(found, self.values[at], np.float32(0))


Shard = dict[str, tuple[np.ndarray, np.ndarray]]


def _score(shard: Shard, mine: np.ndarray):
    """Sums of log10 probabilities over the positions whose byte before is `mine`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {name: _Table(*arrays) for name, arrays in shard.items()}
        everything = mine.all()
        for batch in batches:
            n = batch.num_rows
            sums, lengths = np.zeros(n), np.zeros(n, np.int64)
            for grams, rows in _grams(batch.column(1), ORDER):
                if not len(rows):  # empty texts alone
                    continue
                low, wide = int(rows.min()), int(rows.max() - rows.min()) + 1
                if everything:
                    part, owner = grams, rows - low
                else:
                    keep = mine[((grams >> np.uint64(8)) & np.uint64(255)).astype(np.int64)]
                    part, owner = grams[keep], rows[keep] - low
                sums[low : low + wide] += np.bincount(owner, weights=_log_probability(part, tables), minlength=wide)
                lengths[low : low + wide] += np.bincount(owner, minlength=wide)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(lengths), pa.array(sums)], ["doc_id", "lang", "row", "n", "logp"])

    return run


def _log_probability(grams: np.ndarray, tables: dict[str, _Table]) -> np.ndarray:
    found, out = tables[f"g{ORDER}"].find(grams)
    out = out.astype(np.float64)
    left = np.flatnonzero(~found)
    for k in range(ORDER, 0, -1):
        if not len(left):
            break
        _, weight = tables[f"c{k}"].find((grams[left] & np.uint64((1 << 8 * k) - 1)) >> np.uint64(8))
        out[left] += weight
        if k == 1:
            out[left] += np.log10(1 / 256)
            break
        hit, value = tables[f"g{k - 1}"].find(grams[left] & np.uint64((1 << 8 * (k - 1)) - 1))
        out[left] += value
        left = left[~hit]
    return out


def _ascending(gram: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted here, once, so that no task holds a second copy."""
    order = np.argsort(gram.view(np.uint64))
    return gram.view(np.uint64)[order], value[order].astype(np.float32)


def _shards(grams: DataFrame, contexts: DataFrame) -> Iterator[tuple[Shard, np.ndarray]]:
    """The table in parts of about SHARD_ROWS rows: all that positions after certain bytes need. Order 1 is in each."""
    before = F.shiftright("gram", 8).bitwiseAND(F.lit(255))
    parts = grams.withColumn("kind", F.lit("g")).withColumn("before", F.when(F.col("order") > 1, before))
    parts = parts.unionByName(contexts.withColumn("kind", F.lit("c")).withColumn("before", F.when(F.col("order") > 1, F.col("gram").bitwiseAND(F.lit(255)))))
    parts = materialize(parts, "kn-table")
    sizes = {r["before"]: r["n"] for r in parts.where("before is not null").groupBy("before").agg(F.count(F.lit(1)).alias("n")).collect()}  # 256 rows at most
    groups: list[list[int]] = [[]]
    held = 0
    for byte in range(256):
        if held and held + sizes.get(byte, 0) > SHARD_ROWS:
            groups.append([])
            held = 0
        groups[-1].append(byte)
        held += sizes.get(byte, 0)
    for group in groups:
        rows = parts.where(F.col("before").isNull() | F.col("before").isin(group)).select("kind", "order", "gram", "value").toArrow()
        kind, order, gram, value = (rows.column(i).to_numpy() for i in range(4))
        shard = {f"{a}{k}": _ascending(gram[(kind == a) & (order == k)], value[(kind == a) & (order == k)]) for a in "gc" for k in range(1, ORDER + 1)}
        yield shard, np.isin(np.arange(256), group)


def _sample(good: DataFrame, size: int) -> DataFrame:
    """(learned) of about `size` rows of good (doc_id, lang), by a digest: all of the languages that have few, as many of each
    other."""
    counts = [(r["lang"], r["n"]) for r in good.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()]
    rest, shares = float(size), []
    for k, (lang, n) in enumerate(sorted(counts, key=lambda x: x[1])):
        each = rest / (len(counts) - k)
        shares.append((lang, min(1.0, each / n)))
        rest -= min(n, each)
    shares = good.sparkSession.createDataFrame(shares, "of_lang string, share double")
    picked = good.join(bounded_broadcast(shares, len(counts)), F.col("lang").eqNullSafe(F.col("of_lang")))
    return picked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40) < F.col("share")).select(F.col("doc_id").alias("learned")).distinct()


def classify(docs: DataFrame, trusted: DataFrame, trusted_docs: int = TRUSTED_DOCS) -> DataFrame:
    """doc_id, lang, n_bytes, mean_logp, perplexity, limit, kept for every row of docs (doc_id, text, lang).

    trusted (doc_id) names documents of docs whose text is good.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("row"))
    ids = trusted.select(F.col("doc_id").cast("long").alias("good")).distinct()
    ids = materialize(ids, "kn-trusted")
    n_ids = ids.count()
    sample = materialize(_sample(rows.select("doc_id", "lang").join(bounded_broadcast(ids, n_ids), F.col("doc_id") == F.col("good"), "left_semi"), trusted_docs), "kn-sample")
    good = rows.join(bounded_broadcast(sample, sample.count()), F.col("doc_id") == F.col("learned"), "left_semi")
    counts = good.select("text").mapInArrow(_count, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))
    grams, contexts = kneser_ney(materialize(counts, "kn-counts"))

    scored: DataFrame | None = None
    n_shards = 0
    for shard, mine in _shards(grams, contexts):
        part = rows.select("doc_id", "text", "lang", "row").mapInArrow(_score(shard, mine), "doc_id long, lang string, row long, n long, logp double")
        part = materialize(part, "kn-scores")
        scored = part if scored is None else scored.unionByName(part)
        n_shards += 1
    if n_shards > 1:
        # a row that repeats adds up in every shard alike
        scored = scored.groupBy("doc_id", "lang", "row").agg(F.sum("n").alias("n"), F.sum("logp").alias("logp"), F.count(F.lit(1)).alias("times"))
        times = F.col("times") / n_shards
        scored = scored.select("doc_id", "lang", (F.col("n") / times).cast("long").alias("n"), (F.col("logp") / times).alias("logp"), F.explode(F.sequence(F.lit(1), times.cast("int"))).alias("copy")).drop("copy")
    mean: Column = F.try_divide(F.col("logp"), F.col("n"))
    scored = scored.select("doc_id", "lang", F.col("n").alias("n_bytes"), mean.alias("mean_logp"))

    known = scored.join(bounded_broadcast(ids, n_ids), F.col("doc_id") == F.col("good"), "left_semi").where("mean_logp is not null")
    limit = (F.expr(f"percentile_approx(mean_logp, {QUANTILE}, 100000)") - MARGIN).alias("limit")
    limits = materialize(known.groupBy(F.col("lang").alias("of_lang")).agg(limit), "kn-limits")
    whole = known.agg(limit).first()["limit"]
    out = scored.join(limits, F.col("lang").eqNullSafe(F.col("of_lang")), "left").drop("of_lang")
    bound = F.coalesce(F.col("limit"), F.lit(whole).cast("double"))
    kept = F.coalesce(F.col("mean_logp") >= bound, F.col("mean_logp").isNotNull())
    return out.select("doc_id", "lang", "n_bytes", "mean_logp", F.pow(F.lit(10.0), -F.col("mean_logp")).alias("perplexity"), bound.alias("limit"), kept.alias("kept"))
