"""Exact Jaccard join of documents' shingle sets in the metric space of Jaccard distance d = 1 - J.

1. Documents with the same set fall into one class; classes are compared, copies are not.
2. In this space almost every pair lies at distance 1, where no pivot tells two documents apart by the triangle
   inequality. So regions are opened only where documents can be near: around each shingle of the rare-first prefix that
   two linked sets must share (exact for every order; rarity is read from a table of 2**22 slots counted over all
   documents, which moves the work away from common passages and never alters a result). Shingles that the same classes
   share open one region, in which a class keeps its foremost place.
3. A region recurses by pivots. Documents within the radius of a pivot fall into its Voronoi cell and need no test against
   each other, since they are connected through it. Cells that links connect, in whatever region, are one cell. Documents
   of different cells meet only inside the triangle-inequality window d(x,p) - d(y,p) <= radius, either way round: those
   near a boundary stay in the region for the next round, which draws more pivots. A region ends when one cell is left;
   regions of at most LEAF documents compare what is left directly.
4. A distance is bounded from below by the sets' bit maps (a bit is the parity of the shingles that hash to it, so unlike
   bits are unlike shingles). Pairs that the bound sets apart are done; only the others' texts meet, and give the exact
   distance. Windows use the bounds where the distance itself was not needed.
5. The cells in the end are the components; a component's id is its smallest doc_id.

The frequent shingles' rows are spread by a salt before they are sorted; all else is partial aggregation and plain joins.

Defined cases: null text or text without words has no shingles and is alone; fewer than five words are one shingle; rows
with the same set are one class, whatever their doc_id; rows that repeat a doc_id with another text are rows of their own,
each in its text's component; a null doc_id comes after all others; an empty table gives an empty result; other columns are ignored. Shingles are told apart by
a 64-bit hash, sets by their size and 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import shingles
from plumbline.llm.common import bounded_broadcast, materialize, release, row_hash
from plumbline.llm.components import extended

SIMILARITY = 75  # percent
RADIUS = 1 - SIMILARITY / 100
SLOT_BITS, BLOCKS, FAN_IN = 22, 32, 32
LEAF = 16
#: A region's pivots grow by this factor from round to round.
GROWTH = 16
#: A slot with this many times the mean count is frequent.
FREQUENT = 8
#: Rows of one shingle that a task holds to see which classes share it; longer runs are summed up by Spark.
RUN = 4096
#: Bits of a bit map: a power of two that is the set's size or more, within these.
LEAST_BITS, MOST_BITS = 64, 1 << 16
VERIFY_ROWS = 64

U64 = np.uint64
_DESCRIBED = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("bits", pa.binary()), ("part", pa.int32()), ("block", pa.int32()), ("counts", pa.binary())])
DESCRIBED = "doc_id long, row long, n long, sig binary, bits binary, part int, block int, counts binary"


def _slot(values: np.ndarray) -> np.ndarray:
    return (values >> U64(64 - SLOT_BITS)).astype(np.int64)


def _signatures(n: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Two 64-bit sums of each set's hashes."""
    ends = np.cumsum(n)
    halves = []
    for seed in (0x243F6A8885A308D3, 0x13198A2E03707344):
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(shingles.mix(values ^ U64(seed)), dtype=U64)])
        halves.append(sums[ends] - sums[ends - n])
    return np.stack(halves, axis=1)


def _bit_maps(n: np.ndarray, values: np.ndarray) -> list[bytes]:
    size = np.clip(2 ** np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), LEAST_BITS, MOST_BITS)
    start = np.cumsum(size) - size
    at = np.repeat(start, n) + (shingles.mix(values ^ U64(0x082EFA98EC4E6C89)) & np.repeat(size - 1, n).astype(U64)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=int(size.sum())) & 1).astype(np.uint8)).tobytes()
    return [packed[a : a + b] for a, b in zip(start // 8, size // 8, strict=True)]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a document: set size, signature and bit map; at the end BLOCKS rows with the partition's slot counts."""
    slots = np.zeros(1 << SLOT_BITS, np.uint32)
    for batch in batches:
        sizes, sigs, bits = [], [], []
        for _, n, values in shingles.shingle_sets(batch.column(1)):
            np.add.at(slots, _slot(values), np.uint32(1))
            sizes.append(n)
            sigs += [row.tobytes() for row in _signatures(n, values)]
            bits += _bit_maps(n, values)
        if batch.num_rows:
            none = [None] * batch.num_rows
            columns = [batch.column(0), batch.column(2), np.concatenate(sizes), sigs, bits, none, none, none]
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) if not isinstance(c, pa.Array) else c for c, k in zip(columns, _DESCRIBED, strict=True)], schema=_DESCRIBED)
    part, each = TaskContext.get().partitionId(), (1 << SLOT_BITS) // BLOCKS
    if slots.any():
        counts = [slots[b * each : (b + 1) * each].tobytes() for b in range(BLOCKS)]
        none = [None] * BLOCKS
        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip([none, none, none, none, none, [part] * BLOCKS, range(BLOCKS), counts], _DESCRIBED, strict=True)], schema=_DESCRIBED)


def _add_counts(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(c, np.uint32).astype(np.uint64) for c in pdf["counts"])
    out = np.minimum(total, 0xFFFFFFFF).astype(np.uint32)
    return pd.DataFrame({"part": [pdf["part"].iloc[0]], "block": [pdf["block"].iloc[0]], "counts": [out.tobytes()]})


def _slot_levels(described: DataFrame) -> tuple[np.ndarray, int]:
    """log2 of each slot's count over all documents, and the level from which on a slot is frequent. 2**22 bytes, whatever
    the input; partitions are added up in a tree, FAN_IN at a time."""
    counts = described.where("block is not null").select("part", "block", "counts")
    parts = (counts.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        parts = -(-parts // FAN_IN)
        counts = counts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("block", "part").applyInPandas(_add_counts, "part int, block int, counts binary")
    total = np.zeros((BLOCKS, (1 << SLOT_BITS) // BLOCKS), np.uint32)
    for r in counts.toLocalIterator():
        total[r["block"]] = np.frombuffer(r["counts"], np.uint32)
    levels = np.log2(total.ravel() + np.float32(1)).astype(np.uint8)
    return levels, int(np.log2(FREQUENT * max(total.mean(dtype=np.float64), 8) + 1))


def _prefixes(levels: np.ndarray, frequent: int):
    """(s, key, about) for the prefix of every set that the task has not met before."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for batch in batches:
            for _, n, values in shingles.shingle_sets(batch.column(0)):
                sigs = _signatures(n, values)
                fresh = np.zeros(len(n), bool)
                for i, sig in enumerate(sigs):
                    if n[i] and (name := sig.tobytes()) not in met:
                        met.add(name)
                        fresh[i] = True
                owner = np.repeat(np.arange(len(n)), n)
                values, owner = values[fresh[owner]], owner[fresh[owner]]
                n = np.where(fresh, n, 0)
                level = levels[_slot(values)]
                # values ascend within an owner already, so one stable sort by (owner, level) is enough
                order = np.argsort(owner * 64 + level, kind="stable")
                values, level = values[order], level[order]
                place = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
                size = np.repeat(n, n)
                keep = place <= size - -(-SIMILARITY * size // 100)
                about = size[keep] << 32 | place[keep] << 1 | (level[keep] >= frequent)
                yield pa.RecordBatch.from_arrays([pa.array(values[keep].view(np.int64)), pa.array(sigs[owner[keep], 0].view(np.int64)), pa.array(about)], ["s", "key", "about"])

    return emit


def _hopeless(about: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of runs of two rows, those that can't be linked through their shingle."""
    n, m, i, j = about[first] >> 32, about[first + 1] >> 32, (about[first] & 0xFFFFFFFF) >> 1, (about[first + 1] & 0xFFFFFFFF) >> 1
    return (100 * np.minimum(n, m) < SIMILARITY * np.maximum(n, m)) | ((100 + SIMILARITY) * (1 + np.minimum(n - 1 - i, m - 1 - j)) < SIMILARITY * (n + m))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (s, key): (region, key, about, whole) for shingles that two classes or more share.

    A run's region is named by its classes, and `whole` is true; runs that are frequent (other tasks hold rows of them) or
    longer than RUN are named by their shingle. A pair alone stays only if it can be linked through its shingle.
    """
    held = np.zeros((3, 0), np.int64)

    def done(rows: np.ndarray) -> pa.RecordBatch:
        s, key, about = rows
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (key[1:] != key[:-1])
        s, key, about = s[new], key[new], about[new]
        edge = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(edge, len(s)))
        often = about[edge] & 1 == 1 if len(s) else np.zeros(0, bool)
        stay = (sizes > 1) | often
        two = np.flatnonzero((sizes == 2) & ~often)
        stay[two[_hopeless(about, edge[two])]] = False
        loose = often | (sizes > RUN)
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(shingles.mix(key.view(U64) ^ U64(0x452821E638D01377)), dtype=U64)])
        name = shingles.mix(sums[edge + sizes] - sums[edge] + sizes.astype(U64)).view(np.int64)
        region = np.where(loose, s[edge] if len(s) else name, name)
        keep = np.repeat(stay, sizes)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (np.repeat(region, sizes)[keep], key[keep], about[keep], np.repeat(~loose, sizes)[keep])], ["region", "key", "about", "whole"])

    for batch in batches:
        held = np.concatenate([held, np.stack([batch.column(i).to_numpy() for i in range(3)])], axis=1)
        if held.shape[1]:
            last = int(np.searchsorted(held[0], held[0, -1]))  # the last run may go on
            if held.shape[1] - last > 4 * RUN:  # it is loose anyway, in parts of this task's rows
                yield done(held[:, :last])
                run = held[:, last:]
                names = np.append(True, run[1, 1:] != run[1, :-1])[:-1]
                run, rest = run[:, :-1][:, names], run[:, -1:]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (run[0], run[1], run[2] | 1, np.zeros(run.shape[1], bool))], ["region", "key", "about", "whole"])
                held = rest | np.array([[0], [0], [1]])
            elif last:
                yield done(held[:, :last])
                held = held[:, last:]
    yield done(held)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, sig, text) of rows (doc_id, text)."""
    for batch in batches:
        sizes, sigs = [], []
        for _, n, values in shingles.shingle_sets(batch.column(1)):
            sizes.append(n)
            sigs += [row.tobytes() for row in _signatures(n, values)]
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(sizes)), pa.array(sigs, pa.binary()), batch.column(1)], ["doc_id", "n", "sig", "text"])


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, lo): no pair (a, b, n, m, bits of a, bits of b) is nearer than lo."""
    for batch in batches:
        n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        x, y = batch.column(4).to_pylist(), batch.column(5).to_pylist()
        unlike = np.abs(n - m)
        kinds: dict[tuple[int, int], list[int]] = {}
        for i, (p, q) in enumerate(zip(x, y, strict=True)):
            kinds.setdefault((len(p), len(q)), []).append(i)
        for (p, q), rows in kinds.items():
            both = []
            for bits, size in ((x, p), (y, q)):
                flat = np.frombuffer(b"".join(bits[i] for i in rows), np.uint8).reshape(len(rows), size)
                least = min(p, q)
                both.append(np.bitwise_xor.reduce(flat.reshape(len(rows), size // least, least), axis=1))
            unlike[rows] = np.maximum(unlike[rows], np.bitwise_count(both[0] ^ both[1]).sum(axis=1, dtype=np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(2 * unlike / (n + m + unlike))], ["a", "b", "lo"])


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both, either = [], []
        for at in range(0, batch.num_rows, VERIFY_ROWS):
            some = batch.slice(at, VERIFY_ROWS)
            sizes, values, owners = np.zeros(some.num_rows, np.int64), [], []
            for column in (2, 3):
                for first, n, v in shingles.shingle_sets(some.column(column)):
                    sizes[first : first + len(n)] += n
                    values.append(v)
                    owners.append(first + np.repeat(np.arange(len(n)), n))
            v, o = np.concatenate(values), np.concatenate(owners)
            order = shingles.by_owner(v, o, some.num_rows)
            v, o = v[order], o[order]
            common = np.bincount(o[1:][(v[1:] == v[:-1]) & (o[1:] == o[:-1])], minlength=some.num_rows)
            both.append(common)
            either.append(sizes - common)
        if both:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(both)), pa.array(np.concatenate(either))], ["a", "b", "both", "either"])


def _near_sizes(n: str, m: str) -> Column:
    """Sizes that a linked pair can have."""
    return 100 * F.least(n, m) >= SIMILARITY * F.greatest(n, m)


def _reachable(n: str, i: str, m: str, j: str) -> Column:
    """Sets whose first common shingle has these places can still overlap enough."""
    best = 1 + F.least(F.col(n) - 1 - F.col(i), F.col(m) - 1 - F.col(j))
    return (100 + SIMILARITY) * best >= SIMILARITY * (F.col(n) + F.col(m))


class _Distances:
    """Distances of pairs of classes, each pair looked at once: `known` has (a, b, lo, hi), `cells` what links connect."""

    def __init__(self, docs: DataFrame, classes: DataFrame) -> None:
        self.docs, self.classes = docs, classes
        self.known: DataFrame | None = None
        self.cells: DataFrame | None = None

    def look_at(self, pairs: DataFrame) -> None:
        pairs = pairs.distinct()
        if self.known is not None:
            pairs = pairs.join(self.known, ["a", "b"], "left_anti")
        about = self.classes.select("node", "n", "bits")
        rows = pairs.join(about.withColumnsRenamed({"node": "a", "bits": "x"}), "a").join(about.withColumnsRenamed({"node": "b", "n": "m", "bits": "y"}), "b")
        bounded = materialize(rows.select("a", "b", "n", "m", "x", "y").mapInArrow(_bounds, "a long, b long, lo double"), "jaccard-bounds")
        near = materialize(bounded.where(F.col("lo") <= RADIUS + 1e-9).select("a", "b"), "jaccard-near")
        exact = self._exact(near)
        known = bounded.join(exact.select("a", "b", (1 - F.col("both") / F.col("either")).alias("d")), ["a", "b"], "left")
        known = known.select("a", "b", F.coalesce("d", "lo").alias("lo"), F.coalesce("d", F.lit(1.0)).alias("hi"))
        superseded = [t for t in (bounded, near, exact, self.known, self.cells) if t is not None]
        self.known = materialize(known if self.known is None else self.known.unionByName(known), "jaccard-known")
        links = exact.where(100 * F.col("both") >= SIMILARITY * F.col("either")).select("a", "b")
        self.cells = materialize(extended(self.cells, links), "jaccard-cells")
        release(*superseded)

    def _exact(self, pairs: DataFrame) -> DataFrame:
        """Overlaps (a, b, both, either) from the texts."""
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        nodes = materialize(nodes.join(self.classes.select("node", "rep", "n", "sig"), "node"), "jaccard-nodes")
        ids = nodes.select(F.col("rep").alias("id")).distinct()
        texts = self.docs.join(bounded_broadcast(ids, nodes.count()), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
        texts = texts.select("doc_id", "text").mapInArrow(_keyed, "doc_id long, n long, sig binary, text string")
        texts = texts.join(nodes, (F.col("doc_id").eqNullSafe(F.col("rep"))) & (texts["n"] == nodes["n"]) & (texts["sig"] == nodes["sig"])).select("node", "text")
        texts = materialize(texts.groupBy("node").agg(F.first("text").alias("text")), "jaccard-texts")
        rows = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "ta"}), "a").join(texts.withColumnsRenamed({"node": "b", "text": "tb"}), "b")
        out = materialize(rows.select("a", "b", "ta", "tb").mapInArrow(_overlap, "a long, b long, both long, either long"), "jaccard-overlaps")
        release(nodes, texts)
        return out


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _worth() -> Column:
    """Whether a pair can be a link that is not implied: other cells, fitting sizes and places, inside every window."""
    apart = F.col("cell") != F.col("p_cell")
    outside = F.exists(F.zip_with("ds", "p_ds", lambda x, y: F.greatest(x["lo"] - y["hi"], y["lo"] - x["hi"])), lambda gap: F.coalesce(gap > RADIUS + 1e-9, F.lit(False)))
    return apart & _near_sizes("n", "p_n") & _reachable("n", "pos", "p_n", "p_pos") & ~outside


def _at_home(active: DataFrame, distances: _Distances) -> DataFrame:
    """active with cells: every document has met the first pivot of its largest region. Groups of near copies share many
    regions, and their largest one connects most of them before the others are looked at."""
    sized = materialize(active.groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.min_by(F.struct("node", "n", "pos"), F.xxhash64("node")).alias("p")), "jaccard-homes")
    home = active.select("region", "node").join(sized.select("region", "size"), "region").groupBy("node").agg(F.max(F.struct("size", "region")).alias("home"))
    rows = home.select("node", "home.region").join(active, ["node", "region"]).join(sized.select("region", *(F.col("p")[c].alias(f"p_{c}") for c in ("node", "n", "pos"))), "region")
    distances.look_at(rows.where((F.col("node") != F.col("p_node")) & _near_sizes("n", "p_n") & _reachable("n", "pos", "p_n", "p_pos")).select(*_pair("node", "p_node")))
    with_cells = active.drop("cell").join(distances.cells, "node", "left")
    with_cells = with_cells.select("region", "node", "n", "pos", F.coalesce("component", "node").alias("cell"), "ds")
    out = materialize(_open_regions(materialize(with_cells, "jaccard-left")), "jaccard-active")
    release(active, sized)
    return out


def _open_regions(rows: DataFrame) -> DataFrame:
    """Rows of regions that hold more than one cell."""
    more = rows.groupBy("region").agg(F.min("cell").alias("lo"), F.max("cell").alias("hi")).where("lo != hi").select("region")
    return rows.join(more, "region", "left_semi")


def _join_regions(regions: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, component) of all classes that have links, from the regions' rows (region, node, n, pos)."""
    distances = _Distances(docs, classes)
    carried = ("node", "n", "pos", "cell", "ds")
    active = regions.select("region", "node", "n", "pos", F.col("node").alias("cell"), F.array().cast("array<struct<lo:double,hi:double>>").alias("ds"))
    active = _at_home(materialize(active, "jaccard-active"), distances)
    pivots_each = 1
    while True:
        largest = active.groupBy("region").count().agg(F.max("count")).first()[0] or 0
        if largest <= LEAF:
            break
        first = F.xxhash64("node")
        slot = F.pmod(F.xxhash64(F.col("node"), F.lit(pivots_each)), F.lit(pivots_each)).alias("slot")
        pivots = active.groupBy("region", slot).agg(F.min_by(F.struct(*carried), first).alias("p"), F.min(first).alias("first"))
        lead = pivots.groupBy("region").agg(F.min("first").alias("lead"))
        pivots = pivots.join(lead, "region").select("region", *(F.col("p")[c].alias(f"p_{c}") for c in carried), (F.col("first") == F.col("lead")).alias("leads"))
        pivots = materialize(pivots, "jaccard-pivots")
        met = active.join(pivots, "region").where((F.col("node") != F.col("p_node")) & _worth())
        met = materialize(met.select("region", "node", "leads", *_pair("node", "p_node")), "jaccard-met")
        distances.look_at(met.select("a", "b"))
        lead_d = met.where("leads").join(distances.known, ["a", "b"]).select("region", "node", F.struct("lo", "hi").alias("lead_d"))
        left = active.join(pivots.select("region", F.col("p_node").alias("node")), ["region", "node"], "left_anti")
        left = left.join(lead_d, ["region", "node"], "left").join(distances.cells, "node", "left")
        left = left.select("region", "node", "n", "pos", F.coalesce("component", "node").alias("cell"), F.concat("ds", F.array("lead_d")).alias("ds"))
        left = materialize(left, "jaccard-left")
        superseded = (active, pivots, met, left)
        active = materialize(_open_regions(left), "jaccard-active")
        release(*superseded)
        pivots_each *= GROWTH
    other = active.select("region", *(F.col(c).alias(f"p_{c}") for c in carried))
    rest = active.join(other, "region").where((F.col("node") < F.col("p_node")) & _worth())
    distances.look_at(rest.select(*_pair("node", "p_node")))
    release(active, distances.known)
    return distances.cells


def _regions(docs: DataFrame, classes: DataFrame, levels: np.ndarray, frequent: int) -> DataFrame:
    """(region, node, n, pos): the classes of every region, each with its foremost place."""
    # about: set size << 32 | place in the prefix << 1 | frequent
    rows = docs.select("text").mapInArrow(_prefixes(levels, frequent), "s long, key long, about long")
    salt = F.when(F.col("about").bitwiseAND(F.lit(1)) == 1, F.xxhash64("key")).otherwise(F.lit(0))
    rows = rows.repartition("s", salt).sortWithinPartitions("s", "key").mapInArrow(_shared, "region long, key long, about long, whole boolean")
    rows = materialize(rows, "jaccard-prefixes")
    # frequent shingles: which classes share one is summed up over all tasks
    loose = rows.where("not whole").select("region", "key", F.col("about").bitwiseAND(F.lit(-2)).alias("about")).distinct()
    xors = [F.bit_xor(F.xxhash64(F.lit(seed), F.col("key"))).alias(f"xor{seed}") for seed in (1, 2)]
    names = loose.groupBy("region").agg(F.count(F.lit(1)).alias("size"), *xors).where("size > 1").select("region", F.xxhash64("size", "xor1", "xor2").alias("name"))
    loose = loose.join(names, "region").select(F.col("name").alias("region"), "key", "about")
    every = rows.where("whole").select("region", "key", "about").unionByName(loose)
    place = F.shiftright(F.col("about").bitwiseAND(F.lit(0xFFFFFFFF)), 1).cast("int")
    every = every.groupBy("region", "key", F.shiftright("about", 32).cast("int").alias("n")).agg(F.min(place).alias("pos"))
    named = classes.select("node", F.col("n").cast("int").alias("n"), "key")
    out = materialize(every.join(named, ["key", "n"]).select("region", "node", "n", "pos"), "jaccard-regions")
    release(rows)
    return out


def _key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), batch.column(4), pa.array(sig[:, 0])], ["n", "sig", "rep", "bits", "row", "key"])


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, row_hash, is_first for every row of docs (doc_id, text); is_first: of the
    component's rows the one with the smallest doc_id, true for every row alike in doc_id and text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = materialize(docs.withColumn("row", row_hash(F.col("doc_id"), F.col("text"))).mapInArrow(_describe, DESCRIBED), "jaccard-sets")
    levels, frequent = _slot_levels(described)
    sets = described.where("block is null").select("doc_id", "row", "n", "sig")
    classes = described.where("block is null and n > 0").groupBy("n", "sig").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"), F.first("bits").alias("bits"))
    classes = classes.select("n", "sig", "first.doc_id", "bits", "first.row").mapInArrow(_key, "n long, sig binary, rep long, bits binary, row long, key long")
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "jaccard-classes")
    cells = _join_regions(_regions(docs, classes, levels, frequent), docs, classes)
    rows = classes.select("n", "sig", F.struct(F.col("rep").isNull(), "rep", "row").alias("first"), "node").join(cells, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = rows.groupBy("component").agg(F.min("first").alias("first"))
    joined = materialize(rows.drop("first").join(smallest, "component").select("n", "sig", "first"), "jaccard-components")
    release(classes, cells)
    out = sets.join(joined, ["n", "sig"], "left")
    alone = F.col("first").isNull()
    first = F.when(alone, True).otherwise(F.col("first.rep").eqNullSafe(F.col("doc_id")) & (F.col("first.row") == F.col("row")))
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("first.rep"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("row").alias("row_hash"), first.alias("is_first"))
