"""Source divergence audit: which sources of a language use other terms than its other sources, and which terms set a source
apart.

Chunk factorization. A chunk is what stands between ASCII white space. Each document's distinct chunks are counted in the
task that reads it, summed over the documents of an Arrow batch, and summed by (language, source, chunk) over the corpus.
Each globally distinct chunk is then taken apart into terms once, in partitions sorted by chunk, and its terms take over the
chunk's counts. Terms are runs of ASCII letters and of characters beyond ASCII; A-Z are lower-cased.

A language keeps the terms that at least `min_docs` (1 to 3) of its documents have. Two chunks of one document can share a
term, so documents must not be added up over chunks. With every count go the smallest and the largest row number of the
documents counted: up to two documents, these are all of them. A term is kept when a chunk alone or several sources show
enough documents, dropped when even the sum over its chunks shows too few, and in between its documents' row numbers are
counted. So nothing is ever grouped by document.

Between groups (language, source), p = 1 + floor(1e9 (count + 1) / (N + V)), f(p, q) = floor((p - q)^2 / q), in integers.
A pair of sources sums f over all kept terms, those that neither has included, without listing them: what a source has where
the other has nothing is a histogram of its counts, and terms that both have are summed, pair by pair, in the task that has
the term's row of sources (one entry a source, as the result has one row for every two).

Defined cases: null text, language and source are ''; every row is a document, also one that repeats; a group without terms
takes part; a language without kept terms has value 0 for its pairs; equal values are ranked by item; an empty table gives an
empty result; doc_id and other columns are not read. docs should be a stored table, so that row numbers are the same when a
lost task runs again.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import bounded_broadcast, drop_finished, materialize, release

MIN_DOCS, TOP_TERMS, SCALE = 3, 200, 1_000_000_000
SLICE, PARTS = 24 << 20, 4

#: Every byte that no term has becomes a blank, but for the line feed, which ends a chunk; A-Z become a-z.
_TERM_BYTES = bytes(b if b >= 128 or 97 <= b <= 122 or b == 10 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_GROUP = "lang string, source string"
_COUNTS = "n long, docs long, lo long, hi long"


def _count_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of each document, summed over the documents of a group in the batch. Null stands for one occurrence, for one
    document, and for hi where it is lo."""
    for batch in (part for whole in batches for part in _slices(whole)):
        text, ids = batch["text"], batch["id"].to_numpy(zero_copy_only=False)
        lists = pc.ascii_split_whitespace(text)
        chunks, row = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        full = pc.greater(pc.binary_length(chunks), 0)
        row, coded = row[full.to_numpy(zero_copy_only=False)], chunks.filter(full).dictionary_encode()
        if not len(row):
            continue
        of_row, names = _groups(batch)
        by_text = pc.sort_indices(coded.dictionary)  # rows in order of their text compress well when they are shuffled
        ordered, n_chunks = coded.dictionary.take(by_text), len(by_text)
        place = np.empty(n_chunks, np.int64)
        place[by_text.to_numpy()] = np.arange(n_chunks)
        place = place[coded.indices.to_numpy(zero_copy_only=False)]
        row = row.astype(np.int32)
        size = -(-n_chunks // PARTS)
        for part in range(PARTS):  # chunks from one end of the order to the other
            mine = (place >= part * size) & (place < (part + 1) * size)
            if mine.any():
                yield _summed(row[mine], place[mine], ordered, of_row, names, ids)


def _summed(row: np.ndarray, chunk: np.ndarray, texts: pa.Array, of_row: np.ndarray, names: list[tuple[str, str]], ids: np.ndarray) -> pa.RecordBatch:
    n_chunks = len(texts)
    by_row, n = np.unique(row * np.int64(n_chunks) + chunk, return_counts=True)
    row, chunk = by_row // n_chunks, by_row % n_chunks
    key = of_row[row] * n_chunks + chunk
    order = np.argsort(key, kind="stable")  # rows of a group and chunk stay in order
    row, n, key = row[order], n[order], key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    last = np.append(at[1:], len(key)) - 1
    of = pa.array(key[at] // n_chunks)
    lang, source = (pa.array([name[k] for name in names], pa.string()).take(of) for k in (0, 1))
    first, second = ids[row[at]], ids[row[last]]
    lo, hi, n, docs = np.minimum(first, second), np.maximum(first, second), np.add.reduceat(n, at), last - at + 1
    once = [pa.array(x.astype(np.int64), mask=x == usual) for x, usual in ((n, 1), (docs, 1), (hi, lo))]  # most are: null is short
    return pa.RecordBatch.from_arrays([lang, source, texts.take(pa.array(key[at] % n_chunks)), once[0], once[1], pa.array(lo), once[2]], ["lang", "source", "chunk", "n", "docs", "lo", "hi"])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about SLICE bytes of text, so that a task's memory does not depend on the documents' length."""
    ends = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def _groups(batch: pa.RecordBatch) -> tuple[np.ndarray, list[tuple[str, str]]]:
    """The number of each row's (lang, source), and what they stand for."""
    seen: dict[tuple[str, str], int] = {}
    of_row = [seen.setdefault(g, len(seen)) for g in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), strict=True)]
    return np.array(of_row, np.int64), list(seen)


def _take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk: each distinct chunk becomes terms once, which take over the counts of all its rows."""
    for batch in batches:
        coded = batch["chunk"].dictionary_encode()
        lines = b"\n".join(coded.dictionary.cast(pa.binary()).to_pylist()).translate(_TERM_BYTES).split(b"\n")
        found = [line.split() for line in lines]
        counts = np.array([len(f) for f in found], np.int64)
        starts = np.concatenate([[0], np.cumsum(counts)])
        code = coded.indices.to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(code)), counts[code])
        place = np.arange(len(row)) - np.repeat(np.cumsum(counts[code]) - counts[code], counts[code]) + starts[code[row]]
        terms = pa.array([t for f in found for t in f], pa.binary()).cast(pa.string())
        # a term that a chunk has more than once: occurrences add up, documents do not
        first, times = _repeats(terms, row, place)
        taken = batch.take(pa.array(row[first]))
        n = pc.multiply(taken["n"], pa.array(times))
        yield pa.RecordBatch.from_arrays([taken["lang"], taken["source"], terms.take(pa.array(place[first])), n, taken["docs"], taken["lo"], taken["hi"]], ["lang", "source", "term", "n", "docs", "lo", "hi"])


def _repeats(terms: pa.Array, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code = terms.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    _, first, times = np.unique(row * (int(code.max(initial=0)) + 1) + code[place], return_index=True, return_counts=True)
    return first, times.astype(np.int64)


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, n_lang): occurrences of each kept term in each group that has it, and in its language. A table
    of the shared folder; release it when done."""
    if not 1 <= min_docs <= 3:
        raise ValueError("min_docs is 1, 2 or 3")
    rows = docs.select(_text("lang"), _text("source"), _text("text"), F.monotonically_increasing_id().alias("id"))
    one = F.lit(1).cast("long")
    totals = [F.sum(F.coalesce("n", one)).alias("n"), F.sum(F.coalesce("docs", one)).alias("docs"), F.min("lo").alias("lo"), F.max(F.coalesce("hi", "lo")).alias("hi")]
    chunks = rows.mapInArrow(_count_chunks, f"{_GROUP}, chunk string, {_COUNTS}").repartition("chunk")
    chunks = chunks.groupBy("chunk", "lang", "source").agg(*totals).sortWithinPartitions("chunk")
    pieces = materialize(chunks.mapInArrow(_take_apart, f"{_GROUP}, term string, {_COUNTS}"), "audit-pieces")
    for _ in range(3):  # the finished plan is let go within seconds, and with it
        time.sleep(2)
        drop_finished(docs.sparkSession)  # the chunks' shuffle files, before the next ones come
    shown = F.greatest(F.max("docs"), F.when(F.min("lo") < F.max("hi"), 2).otherwise(1))
    cells = materialize(pieces.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), shown.alias("least"), F.sum("docs").alias("most")), "audit-cells")
    terms = cells.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("least").alias("least"), F.sum("most").alias("most"))
    terms = materialize(terms.where(F.col("most") >= min_docs), "audit-terms")
    open_terms = terms.where(F.col("least") < min_docs).select("lang", "term")
    some = pieces.join(open_terms, ["lang", "term"], "left_semi").select("lang", "term", F.explode(F.array("lo", "hi")).alias("id")).distinct()
    shown_all = some.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("shown")).where(F.col("shown") >= min_docs).select("lang", "term")
    kept = terms.where(F.col("least") >= min_docs).select("lang", "term", "n_lang").unionByName(terms.join(shown_all, ["lang", "term"], "left_semi").select("lang", "term", "n_lang"))
    out = materialize(cells.select("lang", "source", "term", "n").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "n_lang"), "audit-counts")
    release(pieces, cells, terms)
    return out


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _p(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE (n + 1) / (total + v)), exactly; null where a language keeps no term."""
    return F.when(v > 0, _div(F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)"), (total + v).cast("decimal(19,0)")) + 1)


def _f(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _times(k: Column, f: Column) -> Column:
    return k.cast("decimal(19,0)") * f.cast("decimal(18,0)")


#: Sums of 64-bit numbers are kept as two, split at this bit.
_LOW = 30


def _shared_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every two sources of a language, over the terms that both have: f(p, q) less what the terms of either add where the
    other is taken to have none. Rows: (lang, sources, their p for the term, their p for a term they have not)."""
    for batch in batches:
        lists = batch["source"]
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(sizes):
            continue
        names = pc.list_flatten(lists).dictionary_encode()
        langs = batch["lang"].dictionary_encode()
        n = len(names.dictionary)
        name = names.indices.to_numpy(zero_copy_only=False).astype(np.int64) + n * np.repeat(langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes)
        p, zero = (pc.list_flatten(batch[c]).to_numpy(zero_copy_only=False) for c in ("p", "zero"))
        starts = np.cumsum(sizes) - sizes
        keys, high, low = [], [], []
        # entries of lists of one size are a matrix; its columns in two orders give all pairs, in parts of bounded size
        for size in np.unique(sizes):
            at = starts[sizes == size]
            for part in np.array_split(at, max(1, len(at) * size * size // 2_000_000)):
                rows = part[:, None] + np.arange(size)
                x, y = (rows[:, i].ravel() for i in np.nonzero(~np.eye(size, dtype=bool)))
                px, qy, p0, q0 = p[x], p[y], zero[x], zero[y]
                value = (px - qy) ** 2 // qy - (px - q0) ** 2 // q0 - (p0 - qy) ** 2 // qy + (p0 - q0) ** 2 // q0
                key, of = np.unique(name[x] * (n * len(langs.dictionary)) + name[y], return_inverse=True)
                sums = np.zeros((2, len(key)), np.int64)
                np.add.at(sums[0], of, value >> _LOW)
                np.add.at(sums[1], of, value & ((1 << _LOW) - 1))
                keys.append(key)
                high.append(sums[0])
                low.append(sums[1])
        key = np.concatenate(keys)
        x, y = np.divmod(key, n * len(langs.dictionary))
        yield pa.RecordBatch.from_arrays(
            [langs.dictionary.take(pa.array(x // n)), names.dictionary.take(pa.array(x % n)), names.dictionary.take(pa.array(y % n)), pa.array(np.concatenate(high)), pa.array(np.concatenate(low))],
            ["lang", "source_g", "source_h", "high", "low"],
        )


def _named(groups: DataFrame, suffix: str, *columns: str) -> DataFrame:
    return groups.select("lang", *(F.col(c).alias(f"{c}_{suffix}") for c in columns))


def _pairs(counts: DataFrame, steps: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of a language's sources. steps: terms k of a group by their count n."""
    g, h = _named(groups, "g", "source", "total", "terms", "zero"), _named(groups, "h", "source", "total", "terms", "zero")
    g, h, v = bounded_broadcast(g, n_groups), bounded_broadcast(h, n_groups), bounded_broadcast(groups.select("lang", "v").distinct(), n_groups)
    key = ["lang", "source_g", "source_h"]
    apart = F.col("source_g") != F.col("source_h")
    one = steps.withColumnRenamed("source", "source_g").join(g, ["lang", "source_g"]).join(v, "lang").join(h, "lang").where(apart)
    one = one.select(*key, _times(F.col("k"), _f(_p(F.col("n"), F.col("total_g"), F.col("v")), F.col("zero_h"))).alias("value"))
    other = steps.withColumnRenamed("source", "source_h").join(h, ["lang", "source_h"]).join(v, "lang").join(g, "lang").where(apart)
    other = other.select(*key, _times(F.col("k"), _f(F.col("zero_g"), _p(F.col("n"), F.col("total_h"), F.col("v")))).alias("value"))
    all_pairs = g.join(h, "lang").where(apart).join(v, "lang")
    neither = all_pairs.select(*key, _times(F.col("v") - F.col("terms_g") - F.col("terms_h"), F.coalesce(_f(F.col("zero_g"), F.col("zero_h")), F.lit(0))).alias("value"))
    both = counts.join(g.withColumnRenamed("source_g", "source"), ["lang", "source"]).join(v, "lang")
    both = both.groupBy("lang", "term").agg(F.collect_list(F.struct("source", _p(F.col("n"), F.col("total_g"), F.col("v")).alias("p"), F.col("zero_g").alias("zero"))).alias("has"))  # one entry a source
    both = both.where(F.size("has") > 1).select("lang", "has.source", "has.p", "has.zero")
    both = both.mapInArrow(_shared_terms, "lang string, source_g string, source_h string, high long, low long")
    both = both.select(*key, (F.col("high").cast("decimal(19,0)") * F.lit(1 << _LOW).cast("decimal(10,0)") + F.col("low")).alias("value"))
    parts = [x.groupBy(*key).agg(F.sum("value").cast("decimal(38,0)").alias("value")) for x in (one, other, neither, both)]
    summed = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).groupBy(*key).agg(F.sum("value").cast("long").alias("value"))
    return summed.select("lang", F.col("source_g").alias("source"), F.col("source_h").alias("item"), "value")


def _terms(counts: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """(lang, source, item, value) of every term that a group uses more than its language."""
    few = bounded_broadcast(groups.select("lang", "source", "total", "v", "total_lang"), n_groups)
    rows = counts.join(few, ["lang", "source"]).withColumns({"p": _p(F.col("n"), F.col("total"), F.col("v")), "q": _p(F.col("n_lang"), F.col("total_lang"), F.col("v"))})
    return rows.where("p > q").select("lang", "source", F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: `pair` rows rank a group's other sources, `term` rows its top terms."""
    counts = term_counts(docs, min_docs)
    groups = docs.select(_text("lang"), _text("source")).distinct()
    of_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("terms"))
    # a term's n_lang stands in each of its groups: the language's total is that of its groups
    of_lang = counts.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v")).join(of_group.groupBy("lang").agg(F.sum("total").alias("total_lang")), "lang")
    groups = groups.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["total", "terms", "v", "total_lang"])
    groups = materialize(groups.withColumn("zero", _p(F.lit(0), F.col("total"), F.col("v"))), "audit-groups")
    steps = materialize(counts.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("k")), "audit-steps")
    n = groups.count()
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pair = _pairs(counts, steps, groups, n).withColumn("rank", F.row_number().over(best))
    term = _terms(counts, groups, n).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_terms)
    columns = ["item", "value", "rank"]
    out = pair.select("lang", "source", F.lit("pair").alias("part"), *columns).unionByName(term.select("lang", "source", F.lit("term").alias("part"), *columns))
    out = materialize(out, "audit-result")
    release(counts, steps, groups)
    return out
