"""Ranked lexical search over a length-stratified index.

A document's score depends on its length only through a whole-numbered normaliser m, so documents with equal m are one
stratum: within it a posting's impact depends on the term and its frequency tf alone, and is computed once per tf. A stratum's
bound for an item is what a document would score that had each of the item's terms as often as any of the stratum has. The
search visits, for each item, the strata with the highest bounds until they hold enough documents; the k-th best score found
there is the item's threshold, and a second visit takes every stratum left whose bound reaches it. Strata below cannot hold a
better document, nor an equal one, so the result is exact.

Items are asked in blocks of about BLOCK_ITEMS, chosen by hash, so that the terms looked for in one pass are bounded. The index
of a block holds the documents' postings of these terms, one row a document, in the shared folder. A visit reads the rows of
its strata; large strata are dealt out to several tasks by a hash of the document, each of which gives back its own k best
documents of an item at most.

Terms are runs of ASCII letters, digits and characters beyond ASCII; A-Z are lower-cased. With N documents that have terms, L
their terms, n a document's terms, df the documents of a term: m = 25 + (75 n N) div L, a term weighs
w = floor(1000 ln((2 N + 2) / (2 df + 1))), a posting gives w ((1e9 tf) div (1000 tf + 8 m)), for each time the item has the term.

Defined cases: null texts have no terms, and their documents and items are in no result; every row is a document, also one that
repeats, and every item row with its own item_id and text is an item once; equal scores are ranked by doc_id, null first; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import bounded_broadcast, materialize, release

TOP, BLOCK_ITEMS = 10, 500
#: Documents that the first visit looks at for an item, about; documents of a stratum in one task, about.
FIRST_DOCS, TASK_DOCS = 5_000, 4_000

#: Every byte that no term has becomes a blank; A-Z become a-z.
_TERM_BYTES = bytes(b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_INDEX = "id long, doc_id long, n long, terms array<int>, tfs array<int>"
_FOUND = "item int, doc_id long, score long"


def _terms(text: bytes) -> Counter[bytes]:
    return Counter(text.translate(_TERM_BYTES).split())


def _post(vocabulary: dict[bytes, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, doc_id, text) to their number of terms and their postings of the vocabulary's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.keys()
        for batch in batches:
            sizes, terms, tfs = [], [], []
            for text in batch["text"].cast(pa.binary()):
                found = _terms(text.as_py())
                own = found.keys() & known
                sizes.append(found.total())
                terms.append([vocabulary[t] for t in own])
                tfs.append([found[t] for t in own])
            yield pa.RecordBatch.from_arrays([batch["id"], batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], ["id", "doc_id", "n", "terms", "tfs"])

    return run


def _factor(tf: np.ndarray | Column, m: int | Column) -> np.ndarray | Column:
    if isinstance(tf, Column):
        return F.call_function("div", F.lit(1_000_000_000) * tf, 1_000 * tf + 8 * m)
    return 1_000_000_000 * tf // (1_000 * tf + 8 * m)


def _visit(wanted: list[list[tuple[int, int]]], weights: np.ndarray, k: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """Scores of one task's documents of a stratum for the items that visit it; k best of each, those below its threshold left
    out. wanted: for each term, (item, times)."""

    def run(key: tuple, docs: pa.Table, visits: pa.Table) -> pa.Table:
        if not docs.num_rows:  # a part of a stratum that the hash gave no document
            return pa.table({"item": pa.array([], pa.int32()), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        m, n_docs = key[0].as_py(), docs.num_rows
        lists = docs["terms"].combine_chunks()
        term = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
        tf = pc.list_flatten(docs["tfs"].combine_chunks()).to_numpy(zero_copy_only=False).astype(np.int64)
        doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        each, of = np.unique(tf, return_inverse=True)
        factor = _factor(each, m)[of]  # once per tf of the stratum
        order = np.argsort(term, kind="stable")
        term, doc, impact = term[order], doc[order], (weights[term] * factor)[order]
        found, starts = np.unique(term, return_index=True)
        slot = {item: at for at, item in enumerate(visits["item"].to_pylist())}
        scores = np.zeros((len(slot), n_docs), np.int64)
        for t, lo, hi in zip(found, starts, [*starts[1:], len(term)], strict=True):
            for item, times in wanted[t]:
                if item in slot:
                    scores[slot[item], doc[lo:hi]] += times * impact[lo:hi]
        ids = docs["doc_id"].to_pylist()
        out: tuple[list, list, list] = ([], [], [])
        for (item, at), least in zip(slot.items(), visits["least"].to_pylist(), strict=True):
            good = np.flatnonzero((scores[at] > 0) & (scores[at] >= least))
            if len(good) > k:  # ties with the k-th stay until they are put in order
                good = good[scores[at][good] >= np.partition(scores[at][good], -k)[-k]]
            best = sorted((-int(scores[at, g]), ids[g] is not None, ids[g] or 0, int(g)) for g in good)[:k]
            out[0].extend([item] * len(best))
            out[1].extend(ids[b[3]] for b in best)
            out[2].extend(-b[0] for b in best)
        return pa.table({"item": pa.array(out[0], pa.int32()), "doc_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.int64())})

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, items: list[tuple[object, bytes]], k: int) -> DataFrame:
    """(item, doc_id, score, rank) for one block of items, item being its number in the block."""
    asked = [_terms(text) for _, text in items]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*asked)))}
    index = materialize(docs.mapInArrow(_post(vocabulary), _INDEX).where("n > 0"), "search-index")
    n_docs, n_terms = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    posts = index.select("n", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("n", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))
    m = (25 + F.call_function("div", F.lit(75).cast("decimal(10,0)") * F.col("n").cast("decimal(14,0)") * F.lit(n_docs).cast("decimal(14,0)"), F.lit(max(n_terms, 1)).cast("decimal(19,0)"))).cast("long")
    strata = materialize(posts.groupBy(m.alias("m"), "term").agg(F.count(F.lit(1)).alias("df"), F.max("tf").cast("long").alias("tf")), "search-strata")
    df = {r["term"]: r["df"] for r in strata.groupBy("term").agg(F.sum("df").alias("df")).collect()}  # one row a term of the block
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)
    wanted: list[list[tuple[int, int]]] = [[] for _ in vocabulary]
    for item, terms in enumerate(asked):
        for t, times in terms.items():
            wanted[vocabulary[t]].append((item, times))
    spark = docs.sparkSession
    rows = [(t, item, int(times * weights[t])) for t, own in enumerate(wanted) for item, times in own]
    asks = bounded_broadcast(spark.createDataFrame(rows, "term int, item int, w long"), len(rows))
    bound = F.sum(F.col("w") * _factor(F.col("tf"), F.col("m"))).alias("bound")
    sizes = index.where(F.size("terms") > 0).groupBy(m.alias("m")).agg(F.count(F.lit(1)).alias("docs"))
    bounds = strata.join(asks, "term").groupBy("item", "m").agg(bound).join(sizes, "m").where("bound > 0")
    before = Window.partitionBy("item").orderBy(F.col("bound").desc(), "m").rowsBetween(Window.unboundedPreceding, -1)
    bounds = materialize(bounds.withColumn("before", F.coalesce(F.sum("docs").over(before), F.lit(0))), "search-bounds")

    def visit(where: DataFrame) -> DataFrame:
        """where: (item, m, least, docs)."""
        parts = where.select("m", F.greatest(F.lit(1), F.ceil(F.col("docs") / TASK_DOCS)).alias("parts")).distinct()
        n = parts.count()
        rows = index.where(F.size("terms") > 0).withColumn("m", m).join(bounded_broadcast(parts, n), "m")
        rows = rows.select("m", F.pmod(F.xxhash64("id"), "parts").alias("part"), "doc_id", "terms", "tfs")
        asking = where.join(parts, "m").select("m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "item", "least")
        cogroup = rows.groupBy("m", "part").cogroup(asking.groupBy("m", "part"))
        return _best(cogroup.applyInArrow(_visit(wanted, weights, k), _FOUND), k)

    first = materialize(visit(bounds.where(F.col("before") < FIRST_DOCS).select("item", "m", F.lit(1).cast("long").alias("least"), "docs")), "search-first")
    least = first.where(F.col("rank") == k).select("item", F.col("score").alias("least"))
    rest = bounds.where(F.col("before") >= FIRST_DOCS).join(F.broadcast(least), "item", "left").withColumn("least", F.coalesce("least", F.lit(1)))
    rest = materialize(rest.where(F.col("bound") >= F.col("least")).select("item", "m", "least", "docs"), "search-visits")
    both = first.select("item", "doc_id", "score").unionByName(visit(rest).select("item", "doc_id", "score"))
    out = materialize(_best(both, k), "search-found")
    release(index, strata, bounds, first, rest)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of docs (doc_id, text) for each item of items (item_id, text)."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("id"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    items = items.select("item_id", "text").where("text is not null").distinct()
    blocks = max(1, math.ceil(items.count() / block_items))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    kind = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in range(blocks):
        own = [(r["item_id"], r["text"].encode()) for r in items.where(F.col("block") == block).orderBy("item_id", "text").collect()]
        if own:
            names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(own)], f"item int, item_id {kind}")
            found = _search_block(rows, own, k).join(F.broadcast(names), "item")
            out = out.unionByName(found.select("item_id", "rank", "doc_id", "score"))
    return out
