"""Best-fit packing of token sequences in bulk-synchronous rounds.

A document's ids are cut into pieces of the capacity, the shorter piece first. Pieces longer than half of the capacity open
a sequence each. Then, round by round:
1. Pieces not yet placed and gaps are range-sorted together by size, pieces before gaps of the same size. A gap stands as
   often as the largest piece that fits it does fit.
2. Successor sweeps, one in each range at the same time, match pieces with gaps as brackets: going up, a gap takes the
   largest piece not taken that is no larger. What a range leaves over - gaps without pieces, then pieces without gaps -
   keeps its depth; shifted by the ranges before, equal depths meet in one more sweep across the ranges.
3. Several pieces that took places of one gap stand in it by the rank of the place. The gap shrinks by their lengths.
When no gap holds the shortest piece left, as many of the longest pieces open sequences as all that is left must fill.

All of it is sorting, joins and sums by Spark; the driver sees how many pieces and gaps there are of each size (at most
`capacity` numbers) and one depth for each range. Ties in size are broken by a hash, so that a length which a third of all
pieces have is many ranges, and a depth holds two rows of a range at most.

Defined cases: null text is empty, a document always has at least its end id; rows that repeat a document are packed once
each; an empty table gives an empty result; other columns of the pieces are carried along, whatever their names, but for
`sequence_id` and `offset`, which are replaced.
"""

from __future__ import annotations

import functools
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import materialize, release, shuffle_partitions

CAPACITY, END_ID = 1024, 2
PIECES = "doc_id long, piece int, start long, length long, ids binary"
#: Rows of a range, about; a task sweeps a range at once.
RANGE_ROWS = 500_000
#: Chunks of text in a generation of those whose ids a worker keeps, and the longest that it keeps.
CHUNKS, CHUNK_LENGTH = 300_000, 64
#: The vocabulary's splitting never joins what is on both sides of a blank before other than white space.
_CHUNK = re.compile(r" (?=\S)")
#: Marks that are a token of their own after a word.
_MARKS = frozenset(",.;:!?")
#: Byte-level vocabularies write a byte that does not print as the next sign from U+0100 on.
_SILENT = [*range(33), *range(127, 161), 173]
_SIGNS = {byte: 256 + k for k, byte in enumerate(_SILENT)}


def _is_word(chunk: str) -> bool:
    """Whether all of it are letters of European scripts: one word for the vocabulary's splitting."""
    return chunk.isalpha() and len(chunk) <= CHUNK_LENGTH and max(chunk) < "\u0530"


class _Ids(dict):
    """Ids of chunks of text, kept as bytes, in two generations: when the young one is full it becomes the old one, and what
    is asked for again comes back, so that rare chunks go and frequent ones stay."""

    def __init__(self, file: str, before: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.before = Tokenizer.from_file(file), before
        self.mark = before.translate(_SIGNS)  # the vocabulary's sign for a blank
        self.old: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            if chunk[-1:] in _MARKS and _is_word(chunk[:-1]):  # the vocabulary's splitting parts a word from a mark after it
                ids = self[chunk[:-1]] + array("I", [self.tokenizer.token_to_id(chunk[-1])]).tobytes()
            elif _is_word(chunk):
                ids = array("I", [t.id for t in self.tokenizer.model.tokenize(self.mark + chunk.encode().decode("latin-1").translate(_SIGNS))]).tobytes()
            else:
                ids = array("I", self.tokenizer.encode(self.before + chunk, add_special_tokens=False).ids).tobytes()
        if len(chunk) <= CHUNK_LENGTH:
            if len(self) >= CHUNKS:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


@functools.lru_cache(maxsize=2)
def _vocabulary(file: str) -> tuple[_Ids, _Ids]:
    """Ids of a text's first chunk and of the others, which have a blank before them."""
    return _Ids(file, ""), _Ids(file, " ")


def token_ids(text: str, file: str) -> bytes:
    """The ids that the tokenizer gives the whole text, little-endian unsigned 32-bit."""
    first, others = _vocabulary(file)
    chunks = _CHUNK.split(text)
    return first[chunks[0]] + b"".join(map(others.__getitem__, chunks[1:]))


def tokenize(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row a piece; ids are little-endian unsigned 32-bit integers. vocabulary: a file of the tokenizers library."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            held = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = token_ids(text.as_py() or "", vocabulary) + end
                n = len(ids) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    for column, value in zip(out, (doc_id, k, a, b - a, ids[4 * a : 4 * b]), strict=True):
                        column.append(value)
                held += n
                if held > 1 << 20:
                    yield _batch(out)
                    out, held = ([], [], [], [], []), 0
            yield _batch(out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(encode, PIECES)


def _batch(columns: tuple[list, ...]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids"])


SWEPT = "id long, size int, gap boolean, place int, part int, depth long, seq long, seq_size int, seq_place int"
_SWEPT = pa.schema([("id", pa.int64()), ("size", pa.int32()), ("gap", pa.bool_()), ("place", pa.int32()), ("part", pa.int32()), ("depth", pa.int64()), ("seq", pa.int64()), ("seq_size", pa.int32()), ("seq_place", pa.int32())])


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted range (id, size, gap, place): its pieces that were matched, with their gap; the rows left over, with
    their depth; and one row without id that has the range's whole depth."""
    part, held = TaskContext.get().partitionId(), list(batches)
    table = pa.Table.from_batches(held) if held else None
    if not table or not table.num_rows:
        return
    ids, size, gap, place = (table.column(i).to_numpy() for i in range(4))
    gap = gap.astype(bool)
    steps = np.where(gap, -1, 1)
    after = np.cumsum(steps)
    depth = after + gap  # of the bracket: the level that it opens or closes
    order = np.argsort(depth, kind="stable")
    pair = np.flatnonzero((depth[order][1:] == depth[order][:-1]) & ~gap[order][:-1] & gap[order][1:])
    piece, taken = order[pair], order[pair + 1]
    alone = np.ones(len(ids), bool)
    alone[piece] = alone[taken] = False
    rows = np.flatnonzero(alone)
    yield _swept(ids[piece], size[piece], gap[piece], place[piece], part, depth[piece], ids[taken], size[taken], place[taken])
    yield _swept(ids[rows], size[rows], gap[rows], place[rows], part, depth[rows], None, None, None)
    yield _swept(None, None, None, None, part, after[-1:], None, None, None, 1)


def _swept(ids, size, gap, place, part: int, depth, seq, seq_size, seq_place, n: int | None = None) -> pa.RecordBatch:
    n = len(ids) if n is None else n
    values = (ids, size, gap, place, np.full(n, part), depth, seq, seq_size, seq_place)
    return pa.RecordBatch.from_arrays([pa.nulls(n, k.type) if v is None else pa.array(v).cast(k.type) for v, k in zip(values, _SWEPT, strict=True)], schema=_SWEPT)


def _matches(pieces: DataFrame, gaps: DataFrame, lengths: list[int], top: int) -> DataFrame:
    """(id, length, seq, place) for the pieces (id, length) that gaps (seq, gap) take in one round; lengths: those
    of the pieces, ascending; top: the largest gap."""
    spark = pieces.sparkSession
    # at most `capacity` rows: how often the largest piece that fits a gap does fit
    times = [(g, g // lengths[k - 1]) for g in range(1, top + 1) if (k := bisect_right(lengths, g))]
    times = spark.createDataFrame(times, "gap int, times int")
    slots = gaps.join(F.broadcast(times), "gap").select(F.col("seq").alias("id"), F.col("gap").alias("size"), F.explode(F.sequence(F.lit(1), "times")).alias("place"))
    rows = slots.select("id", "size", F.lit(True).alias("gap"), "place").unionByName(pieces.select("id", F.col("length").alias("size"), F.lit(False).alias("gap"), F.lit(0).alias("place")))
    order = [F.col("size"), F.col("gap"), F.col("place"), F.xxhash64("id")]
    ranges = max(shuffle_partitions(spark), -(-(pieces.count() + gaps.count()) // RANGE_ROWS))
    swept = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(_sweep, SWEPT)
    swept = materialize(swept, "pack-swept")

    before, total = [], 0
    for part, depth in sorted((r["part"], r["depth"]) for r in swept.where("id is null").select("part", "depth").collect()):  # a row a range
        before.append((part, total))
        total += depth
    before = spark.createDataFrame(before, "part int, before long")
    over = swept.where("id is not null and seq is null").join(F.broadcast(before), "part").withColumn("depth", F.col("depth") + F.col("before"))
    # of one range and depth, a gap left over stands before a piece left over
    level = Window.partitionBy("depth").orderBy("part", F.desc("gap"))
    after = F.lead(F.struct("id", "gap", "place")).over(level).alias("next")
    across = over.select("id", "size", "gap", after).where("not gap and next.gap").select("id", F.col("size").alias("length"), F.col("next.id").alias("seq"), F.col("next.place").alias("place"))
    inside = swept.where("seq is not null").select("id", F.col("size").alias("length"), "seq", F.col("seq_place").alias("place"))
    out = materialize(inside.unionByName(across), "pack-matches")
    release(swept)
    return out


def _sizes(rows: DataFrame, column: str) -> dict[int, int]:
    """How many rows have each size: at most `capacity` numbers."""
    return {r[column]: r["n"] for r in rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).collect()}


def _longest(pieces: DataFrame, sizes: dict[int, int], n: int) -> DataFrame:
    """n of the pieces, longest first; ties by a hash, ranked in buckets of it."""
    for length in sorted(sizes, reverse=True):
        if sizes[length] >= n:
            break
        n -= sizes[length]
    tied = pieces.where(F.col("length") == length).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(max(64, sizes[length] // 10_000))))
    counts = tied.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))  # a row a bucket
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("id"))
    tied = tied.withColumn("rank", rank).join(counts, "bucket").where(F.col("rank") + F.col("before") <= n).select("id", "length")
    return pieces.where(F.col("length") > length).unionByName(tied)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (length, ...) with sequence_id and offset."""
    carried = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    pieces = materialize(pieces.select(F.struct(*carried).alias("piece"), F.col("length").cast("int").alias("length"), F.monotonically_increasing_id().alias("id")), "pack-pieces")
    left = pieces.select("id", "length")
    sizes = _sizes(left, "length")
    if any(size is None or not 0 < size <= capacity for size in sizes):
        raise ValueError(f"piece lengths must be within 1 and {capacity}")

    def opened(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Placements of pieces that open a sequence of their own, and the gaps behind them."""
        here = materialize(rows.select("id", F.col("id").alias("seq"), F.lit(0).alias("offset"), "length"), "pack-placed")
        return here.drop("length"), here.where(F.col("length") < capacity).select("seq", (F.lit(capacity) - F.col("length")).alias("gap"))

    first, gaps = opened(left.where(F.col("length") > capacity // 2))
    placed, left = [first], left.where(F.col("length") <= capacity // 2)
    sizes = {k: n for k, n in sizes.items() if k <= capacity // 2}
    superseded: list[DataFrame] = []  # tables of the round before; the first views stand on tables that stay
    while sizes:
        gap_sizes = _sizes(gaps, "gap")
        if max(gap_sizes, default=0) < min(sizes):
            fill = -(-sum(k * n for k, n in sizes.items()) // capacity)
            taken, more = opened(_longest(left, sizes, fill))
            matches, gaps = [], materialize(more, "pack-gaps")
        else:
            matches = [_matches(left, gaps, sorted(sizes), max(gap_sizes))]
            upto = F.sum("length").over(Window.partitionBy("seq").orderBy("place", "id"))
            taken = matches[0].withColumn("upto", upto).join(gaps, "seq").select("id", "seq", (capacity - F.col("gap") + F.col("upto") - F.col("length")).cast("int").alias("offset"))
            taken = materialize(taken, "pack-placed")
            filled = matches[0].groupBy("seq").agg(F.sum("length").alias("filled"))
            gap = F.col("gap") - F.coalesce("filled", F.lit(0))
            gaps = materialize(gaps.join(filled, "seq", "left").select("seq", gap.cast("int").alias("gap")).where("gap > 0"), "pack-gaps")
        placed.append(taken)
        left = materialize(left.join(taken, "id", "left_anti"), "pack-left")
        release(*matches, *superseded)
        superseded, sizes = [gaps, left], _sizes(left, "length")
    places = functools.reduce(DataFrame.unionByName, placed)
    return pieces.join(places, "id").select("piece.*", F.col("seq").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))
