"""LM scoring with a Brown class bigram model: exchange clustering, class transitions, word emissions.

P(word | previous) = P(class | class of previous) * P(word | class). Every word of the training texts gets a class:
1. Texts are cut into blocks of about BLOCK_BYTES; a block keeps its words once (by 64-bit hash) and its tokens as places
   in that list. Word counts over all blocks come from one aggregation of the blocks' lists.
2. The CLASSES - 1 most frequent words seed the classes; any other word goes where it is found beside most, relative to
   the seed's frequency; words beside no seed share the last class.
3. Exchange rounds, ROUNDS at most: each block counts, for its words, the classes to their left and right; a word's counts
   from all blocks meet, and it moves to the class under which its neighbours are likeliest given the class bigrams of the
   round. Half of the words may move in a round, the other half in the next, as words that move at once may undo each
   other's gain; only the neighbours of that half are written and dealt out. The next bigrams give the likelihood of the classes moved to: if it did not rise, the classes before are
   taken back and the rounds end.
4. With the final classes, every text becomes a sequence of classes; the bigrams of the training texts are counted, and
   every text is scored.

Words reach their blocks by joins on the word and then on the block; no list of all words is ever in one place, and what
is gathered (words, neighbours, bigrams) covers all training texts. Only tables of CLASSES squared are broadcast.

The distribution is proper: in each class one more emission is set aside for unknown words, and each text ends in an end
token, whose class has no other word. Texts start as if after an end.

Defined cases: null and blank text is an end token alone; rows that repeat are scored alike and each count in training;
without training tokens all tokens share one probability; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import shingles
from plumbline.llm.common import drop_finished, materialize, release

CLASSES = 64
BLOCK_BYTES = 16_000_000
#: Exchange rounds at most; they end when the likelihood no longer rises.
ROUNDS = 3
#: States: classes, then the end, then unknown words.
END, UNKNOWN = CLASSES, CLASSES + 1
SIDE = CLASSES + 1
ADD, PRIOR = 0.1, 2.0

BLOCK = "block long, doc_id binary, lengths binary, train binary, tokens binary, words binary"
_BLOCK = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("doc_id", "lengths", "train", "tokens", "words"))])
_NEIGHBOURS = pa.schema([("word", pa.int64()), ("sides", pa.binary()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of consecutive rows (doc_id, text, train)."""
    ids, train, hashes, lengths, held, made = [], [], [], [], 0, 0

    def block() -> pa.RecordBatch:
        words, tokens = np.unique(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), return_inverse=True)
        # frequent words first, and the tokens' four bytes apart: most of them compress to little
        order = np.argsort(-np.bincount(tokens, minlength=len(words)), kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        words, tokens = words[order], place[tokens]
        planes = np.ascontiguousarray(tokens.astype("<i4").view(np.uint8).reshape(-1, 4).T)
        number = (TaskContext.get().partitionId() << 32) + made
        values = (np.concatenate(ids).astype("<i8"), np.concatenate(lengths).astype("<i4"), np.concatenate(train).astype(np.uint8), planes, words.astype("<u8"))
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([v.tobytes()], pa.binary()) for v in values)], schema=_BLOCK)

    for batch in batches:
        doc_id, learn = batch.column(0).fill_null(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)
        learn = learn + 2 * batch.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.uint8)  # train: 1, no doc_id: 2
        for first, rows, h, owner in shingles.word_hashes(batch.column(1)):
            ids.append(doc_id[first : first + rows])
            train.append(learn[first : first + rows])
            hashes.append(h)
            lengths.append(np.bincount(owner, minlength=rows))
            held += 7 * len(h) + 8 * rows
            if held >= BLOCK_BYTES:
                yield block()
                ids, train, hashes, lengths, held, made = [], [], [], [], 0, made + 1
    if ids:
        yield block()


def _open(row: dict) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    kinds = {"doc_id": "<i8", "lengths": "<i4", "train": np.uint8, "tokens": np.uint8, "words": "<u8"}
    ids, lengths, train, tokens, words = (np.frombuffer(row[c], k) for c, k in kinds.items())
    return pa.array(ids, mask=train & 2 > 0), lengths, train & 1 > 0, np.ascontiguousarray(tokens.reshape(4, -1).T).view("<i4").ravel(), words


def _with_ends(values: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """The texts' values with an end after each text."""
    out = np.full(len(values) + len(lengths), end, values.dtype)
    out[np.arange(len(values)) + np.repeat(np.arange(len(lengths)), lengths)] = values
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, place, word, n): n occurrences in training texts; the whole list, words of held-out texts with n = 0."""
    for batch in batches:
        for row in batch.to_pylist():
            _, lengths, train, tokens, words = _open(row)
            n = np.bincount(tokens[np.repeat(train, lengths)], minlength=len(words))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), row["block"])), pa.array(np.arange(len(words), dtype=np.int32)), pa.array(words.view(np.int64)), pa.array(n)], ["block", "place", "word", "n"])


def _sides(row: dict, classes: np.ndarray, limit: int = SIDE) -> Iterator[pa.RecordBatch]:
    """The words of a block with the classes beside them in training texts, those below limit, and its class bigrams."""
    _, lengths, train, tokens, words = _open(row)
    keep = np.repeat(train, lengths)
    lengths, tokens = lengths[train], tokens[keep]
    if not len(lengths):
        return
    line = np.concatenate([[END], _with_ends(classes[tokens].astype(np.int64), lengths, END)])
    who = _with_ends(tokens.astype(np.int64), lengths, -1)
    real = who >= 0
    left, right = line[:-1][real], np.append(line[2:], END)[real] + SIDE
    where, sides = np.concatenate([who[real]] * 2), np.concatenate([left, right])
    if limit < SIDE:
        useful = sides % SIDE < limit
        where, sides = where[useful], sides[useful]
    keys = where * (2 * SIDE) + sides
    keys, n = np.unique(keys.astype(np.uint32) if len(words) * 2 * SIDE < 1 << 32 else keys, return_counts=True)  # half as wide, sorted sooner
    owner, packed = keys // (2 * SIDE), ((keys % (2 * SIDE)).astype(np.int64) << 24 | np.minimum(n, (1 << 24) - 1)).astype("<u4")
    start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])[: len(owner)])
    used, edges = owner[start], np.append(start, len(packed)) * 4
    binary = pa.Array.from_buffers(pa.binary(), len(used), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(packed)])
    none = pa.nulls(len(used), pa.int32())
    yield pa.RecordBatch.from_arrays([pa.array(words[used].view(np.int64)), binary, none, none, pa.nulls(len(used), pa.int64())], schema=_NEIGHBOURS)
    pairs, n = np.unique(line[:-1] * SIDE + line[1:], return_counts=True)
    yield pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.int64()), pa.nulls(len(pairs), pa.binary()), pa.array((pairs // SIDE).astype(np.int32)), pa.array((pairs % SIDE).astype(np.int32)), pa.array(n)], schema=_NEIGHBOURS)


def _seed_sides(seeds: np.ndarray):
    """As _sides, under the seed classes: seeds, sorted, number i is class i; all other words are the last class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = np.frombuffer(row["words"], "<u8")
                at = np.searchsorted(seeds, words)
                hit = seeds[np.minimum(at, len(seeds) - 1)] == words if len(seeds) else np.zeros(len(words), bool)
                yield from _sides(row, np.where(hit, at, CLASSES - 1), CLASSES - 1)

    return run


def _class_sides(blocks: pa.Table, lexicon: pa.Table) -> pa.Table:
    out: list[pa.RecordBatch] = []
    for row in blocks.to_pylist():
        out += _sides(row, _spread(row, lexicon)[0])
    return pa.Table.from_batches(out, schema=_NEIGHBOURS)


def _spread(row: dict, lexicon: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Class (UNKNOWN if none) and count (0 where the lexicon has none) of every word of a block's list."""
    n_words = len(row["words"]) // 8
    classes, counts = np.full(n_words, UNKNOWN, np.uint8), np.zeros(n_words, np.int64)
    for packed in lexicon.to_pylist():
        place = np.cumsum(_whole(packed["places"], "<i4"))
        classes[place] = np.frombuffer(packed["classes"], np.uint8)
        if packed["counts"] is not None:
            counts[place] = _whole(packed["counts"], "<i8")
    return classes, counts


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, row after row, and how many each row has."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return np.ascontiguousarray(raw[at[0] : at[-1]]), np.diff(at)


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte, all lowest bytes first: the high bytes of small numbers compress to nothing."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def _whole(planes: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, place, class[, c]) sorted by block and place as one row for each run of a block: steps from place to
    place, classes, counts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        block, place, kind, *c = (batch.column(i).to_numpy() for i in range(batch.num_columns))
        edges = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block))
        runs = [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]
        steps = [_planes(np.diff(place[r], prepend=0).astype("<i4")) for r in runs]
        kinds = [kind[r].astype(np.uint8).tobytes() for r in runs]
        counts = [_planes(c[0][r].astype("<i8")) if c else None for r in runs]
        yield pa.RecordBatch.from_arrays([pa.array(block[edges[:-1]]), *(pa.array(x, pa.binary()) for x in (steps, kinds, counts))], ["block", "places", "classes", "counts"])


def _choose(weights: np.ndarray):
    """Of rows (word, sides) sorted by word: each word with the class of the greatest weighted sum of its neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.zeros(2 * SIDE)

        def chosen(words: np.ndarray, dense: np.ndarray) -> pa.RecordBatch:
            gain = dense @ weights
            best = np.where(gain.max(axis=1) > gain.min(axis=1), gain.argmax(axis=1), CLASSES - 1)
            return pa.RecordBatch.from_arrays([pa.array(words), pa.array(best.astype(np.int32))], ["word", "class"])

        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column(0).to_numpy()
            raw, sizes = _bytes(batch.column(1))
            entries, sizes = raw.view("<u4"), sizes // 4
            fresh = np.append(True, words[1:] != words[:-1])
            run_of, names = np.cumsum(fresh) - 1, words[fresh]
            dense = np.bincount(np.repeat(run_of, sizes) * (2 * SIDE) + (entries >> 24), weights=entries & 0xFFFFFF, minlength=len(names) * 2 * SIDE).reshape(len(names), 2 * SIDE)
            if last is not None and last == names[0]:
                dense[0] += held
            elif last is not None:
                yield chosen(np.array([last]), held[None])
            last, held = names[-1], dense[-1]
            if len(names) > 1:
                yield chosen(names[:-1], dense[:-1])
        if last is not None:
            yield chosen(np.array([last]), held[None])

    return run


def _moved(neighbours: DataFrame, weights: np.ndarray) -> DataFrame:
    rows = neighbours.where("word is not null").select("word", "sides").repartition("word").sortWithinPartitions("word")
    return rows.mapInArrow(_choose(weights), "word long, class int")


def _bigrams(rows: DataFrame) -> np.ndarray:
    """Class bigram counts: at most SIDE squared rows come to the driver."""
    out = np.zeros((SIDE, SIDE))
    for r in rows.where("a is not null").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        out[r["a"], r["b"]] = r["n"]
    return out


def _exchange_weights(bigrams: np.ndarray) -> np.ndarray:
    """Log likelihood of one more neighbour for each class a word may move to; rows are sides."""
    share = np.log(bigrams.sum(axis=1) + 1.0)
    left = np.log(bigrams + 0.5) - share[None, :]
    right = np.log(bigrams.T + 0.5) - share[None, :]
    return np.concatenate([left, right])[:, :CLASSES]


def _seed_weights(frequency: np.ndarray) -> np.ndarray:
    """Beside a seed counts for the seed's class, relative to the seed's frequency."""
    out = np.zeros((2 * SIDE, CLASSES))
    for i, f in enumerate(frequency):
        out[i, i] = out[SIDE + i, i] = 1 / np.sqrt(f)
    return out


def likelihood(bigrams: np.ndarray) -> float:
    """Log likelihood of the class bigrams, less what the words alone give (the same for all classes): Brown's criterion."""
    n, rows, columns = bigrams[bigrams > 0], bigrams.sum(axis=1), bigrams.sum(axis=0)
    each = lambda x: float((x[x > 0] * np.log(x[x > 0])).sum())
    return each(n) - each(rows) - each(columns)


def _moving(turn: int) -> Column:
    """Whether a word is in the half that may move in a turn."""
    return F.pmod(F.xxhash64("word"), F.lit(2)) == turn % 2


def _exchanged(table: DataFrame, moved: DataFrame, turn: int) -> DataFrame:
    """The table with the classes of half of its words moved."""
    to = moved.select("word", F.col("class").alias("to"))
    joined = table.join(to, "word", "left")
    return materialize(joined.select("word", "c", F.when(_moving(turn), F.coalesce("to", "class")).otherwise(F.col("class")).alias("class")), "brown-classes")


def _lexicon(lists: DataFrame, table: DataFrame, counts: bool = False) -> DataFrame:
    """(block, places, classes, counts) of the known words of every block, packed by runs before they are dealt by block:
    a row a word would take several times the room."""
    rows = lists.select("block", "place", "word").join(table, "word").select("block", "place", F.col("class").cast("int").alias("class"), *(["c"] if counts else []))
    return rows.sortWithinPartitions("block", "place").mapInArrow(_pack, "block long, places binary, classes binary, counts binary")


def _emissions(totals: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Denominators of word emissions by class; one more word is set aside in each class."""
    return totals + ADD * (kinds + 1)


def _sequences(n_tokens: int, n_kinds: int, n_ends: int, totals: np.ndarray, kinds: np.ndarray):
    """One row a text: its sums that need word counts only, and its classes."""
    fields = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("emission", pa.float64()), ("classes", pa.binary())])
    room = n_tokens + ADD * (n_kinds + 1)
    end = np.log10((n_ends + ADD) / room)
    below = np.log10(np.append(_emissions(totals, kinds), [1.0, 1.0]))

    def run(blocks: pa.Table, lexicon: pa.Table) -> pa.Table:
        out = []
        for row in blocks.to_pylist():
            doc_id, lengths, train, tokens, _ = _open(row)
            classes, counts = _spread(row, lexicon)
            emission = np.where(classes < CLASSES, np.log10(counts + ADD) - below[classes], 0.0)
            owner, k = np.repeat(np.arange(len(lengths)), lengths), len(lengths)
            base = np.bincount(owner, weights=np.log10((counts + ADD) / room)[tokens], minlength=k) + end
            known = np.bincount(owner, weights=(counts > 0)[tokens], minlength=k).astype(np.int64) + (n_ends > 0)
            emitted = np.bincount(owner, weights=emission[tokens], minlength=k)
            line = classes[tokens]
            at = np.append(0, np.cumsum(lengths)).astype(np.int32)
            lines = pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(line))])
            columns = [doc_id, *(pa.array(x) for x in (train, lengths.astype(np.int64) + 1, known, base, emitted))]
            out.append(pa.RecordBatch.from_arrays([*columns, lines], schema=fields))
        return pa.Table.from_batches(out, schema=fields)

    return run


def _lines(classes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The class sequences of a column of texts, ends added, and each token's text."""
    flat, lengths = _bytes(classes)
    return _with_ends(flat, lengths, END).astype(np.int64), np.repeat(np.arange(len(lengths)), lengths + 1)


def _count_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SIDE * SIDE, np.int64)
    for batch in batches:
        line, _ = _lines(batch.column(0))
        total += np.bincount(np.append(END, line[:-1]) * SIDE + line, minlength=SIDE * SIDE) if len(line) else 0
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array((used // SIDE).astype(np.int32)), pa.array((used % SIDE).astype(np.int32)), pa.array(total[used])], ["a", "b", "n"])


def _score(log_step: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            line, owner = _lines(batch.column(6))
            steps = log_step[np.append(END, line[:-1]), line] if len(line) else np.zeros(0)
            score = np.bincount(owner, weights=steps, minlength=batch.num_rows) + batch.column(5).to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 2, 3, 4)), pa.array(score)], ["doc_id", "train", "n_tokens", "n_known", "base_score", "score"])

    return run


def _log_steps(bigrams: np.ndarray, totals: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """log10 P(state | state before) over classes, end and unknown words; a row's classes and end sum to one before the
    part set aside for unknown words, which is taken from the emissions, is written out in the last column."""
    share = (bigrams.sum(axis=0) + 1e-3) / (bigrams.sum() + 1e-3 * SIDE)
    step = (bigrams + PRIOR * share[None, :]) / (bigrams.sum(axis=1, keepdims=True) + PRIOR)
    step = np.vstack([step, share[None, :]])
    unknown = step[:, :CLASSES] @ (ADD / _emissions(totals, kinds))
    return np.log10(np.hstack([step, unknown[:, None]]))


def _classed(counts: DataFrame, classes: DataFrame) -> DataFrame:
    """(word, c, class): words beside no class so far are in the last."""
    joined = counts.join(classes, "word", "left")
    return materialize(joined.select("word", "c", F.coalesce("class", F.lit(CLASSES - 1)).alias("class")), "brown-classes")


def score_texts(docs: DataFrame, train: Column) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text).

    base_score is the log10 probability under word counts alone, with ADD added to each count; score the class model's.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("train"))
    blocks = materialize(rows.mapInArrow(_encode, BLOCK), "brown-blocks")
    lists = blocks.mapInArrow(_counts, "block long, place int, word long, n long")
    counts = lists.where("n > 0").groupBy("word").agg(F.sum("n").alias("c"))
    counts = materialize(counts, "brown-counts")
    n_words, n_kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n_ends = rows.where("train").count()
    n_tokens, n_types = n_words + n_ends, n_kinds + (n_ends > 0)

    top = counts.orderBy(F.desc("c"), "word").limit(CLASSES - 1).collect()  # CLASSES - 1 rows
    top.sort(key=lambda r: r["word"] % (1 << 64))
    seeds = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    neighbours = blocks.mapInArrow(_seed_sides(seeds), "word long, sides binary, a int, b int, n long")
    table = _classed(counts, _moved(neighbours, _seed_weights(np.array([r["c"] for r in top], float))))
    best, before = -np.inf, None
    for turn in range(ROUNDS):
        joined = blocks.groupBy("block").cogroup(_lexicon(lists, table).groupBy("block"))
        neighbours = joined.applyInArrow(_class_sides, "word long, sides binary, a int, b int, n long")
        # what stands beside words that may not move decides nothing: the half that moves, and the bigrams (without a word)
        neighbours = materialize(neighbours.where(F.col("word").isNull() | _moving(turn)), "brown-neighbours")
        bigrams = _bigrams(neighbours)
        del joined
        drop_finished(docs.sparkSession)
        if (reached := likelihood(bigrams)) <= best:
            release(neighbours, table)
            table, before = before, None
            break
        superseded = [neighbours] if before is None else [neighbours, before]
        best, before = reached, table
        table = _exchanged(table, _moved(neighbours, _exchange_weights(bigrams)), turn)
        release(*superseded)
        del neighbours, superseded

    made, bigrams, totals, kinds = _classify(blocks, lists, table, n_tokens, n_types, n_ends)
    if before is not None and likelihood(bigrams) <= best:  # the last moves were not good
        release(made)
        made, bigrams, totals, kinds = _classify(blocks, lists, before, n_tokens, n_types, n_ends)
    release(*(t for t in (table, before, blocks, counts) if t is not None))
    scored = made.mapInArrow(_score(_log_steps(bigrams, totals, kinds)), "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(n_tokens).cast("long"))


def _classify(blocks: DataFrame, lists: DataFrame, table: DataFrame, n_tokens: int, n_types: int, n_ends: int) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """Every text's class sequence, the training texts' class bigrams, and the classes' token and word counts."""
    totals, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in table.groupBy("class").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("k")).collect():  # CLASSES rows
        totals[r["class"]], kinds[r["class"]] = r["c"], r["k"]
    joined = blocks.groupBy("block").cogroup(_lexicon(lists, table, True).groupBy("block"))
    made = joined.applyInArrow(_sequences(n_tokens, n_types, n_ends, totals, kinds), "doc_id long, train boolean, n_tokens long, n_known long, base_score double, emission double, classes binary")
    made = materialize(made, "brown-sequences")
    bigrams = _bigrams(made.where("train").select("classes").mapInArrow(_count_bigrams, "a int, b int, n long"))
    return made, bigrams, totals, kinds
