"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are the 2-, 3- and 4-byte strings of the lower-cased text that lie inside a word, a blank at its edges included,
hashed to BUCKETS rows of an embedding. A document's vector is the mean of its subwords' embeddings, the softmax of a
linear map of it the probabilities. Both are trained by stochastic gradient descent in numpy on a bounded sample of the
labelled documents: at most about MAX_DOCS, the same number for each language. A fifth of the sample sets the softmax's
temperature and the score below which a prediction is rejected (`accepted` is false) so that accepted ones are right
with the wanted precision. Since mean and map are linear, prediction needs a table of BUCKETS rows of class scores only
(its size does not depend on the data) and reads every text whole, in slices.

Defined cases: null text and text without a letter get `und` with score 0, not accepted; rows that repeat are predicted
alike; labels that are null are not learned from; without any label all is `und`; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import shingles
from plumbline.llm.common import materialize

BUCKETS, DIM = 1 << 15, 16
MAX_DOCS, EPOCHS, RATE = 6_000, 6, 2.0
PRECISION = 0.99
UNDETERMINED = "und"

_CLASS = np.arange(256, dtype=np.uint32)
_CLASS[:128] = 0
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)


def _slices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(byte classes, row of each, how many of them the slice before had) of about SLICE bytes, a blank before and after every row;
    long rows come in parts that repeat three bytes, so that each subword ends in the new bytes of one part."""
    data, offs = shingles.string_bytes(column)
    row, n = 0, len(offs) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(offs, offs[row] + shingles.SLICE, "right")) - 1)
        lengths = np.diff(offs[row : last + 1])
        text = data[offs[row] : offs[last]]
        if last == row + 1:
            for at in range(0, max(len(text), 1), shingles.SLICE):
                part = _CLASS[text[max(at - 3, 0) : at + shingles.SLICE]]
                part = np.concatenate([np.zeros(1 if at == 0 else 0, np.uint32), part, np.zeros(1 if at + shingles.SLICE >= len(text) else 0, np.uint32)])
                yield part, np.full(len(part), row), min(at, 3)
        else:
            rows = np.repeat(np.arange(last - row), lengths + 2)
            out = np.zeros(len(rows), np.uint32)
            out[np.arange(len(text)) + 2 * np.repeat(np.arange(last - row), lengths) + 1] = _CLASS[text]
            yield out, rows + row, 0
        row = last


def subwords(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, rows) of all subwords, slice by slice."""
    for c, rows, old in _slices(column):
        m = len(c)
        found, owners = [], []
        for width in (2, 3, 4):
            if m < width:
                continue
            k = m - width + 1
            value = np.full(k, width * 0x51ED27, np.uint32)
            good = rows[:k] == rows[width - 1 :]
            good[: max(0, old - width + 1)] = False
            for j in range(width):
                value = value * np.uint32(0x01000193) ^ c[j : j + k]
                if 0 < j < width - 1:
                    good &= c[j : j + k] > 0
            if width == 2:
                good &= (c[:k] | c[1:]) > 0
            value = (value ^ (value >> np.uint32(15))) * np.uint32(0x9E3779B1)
            found.append((value[good] >> np.uint32(17)).astype(np.int64))
            owners.append(rows[:k][good])
        if found:
            yield np.concatenate(found), np.concatenate(owners)


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            counts = np.zeros(BUCKETS, np.int64)
            for found, _ in subwords(batch.column(1).slice(at, 1)):
                counts += np.bincount(found, minlength=BUCKETS)
            used = np.flatnonzero(counts)
            share = (counts[used] / max(counts.sum(), 1)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), pa.array([used.astype(np.uint16).tobytes()], pa.binary()), pa.array([share.tobytes()], pa.binary()), batch.column(2).slice(at, 1)], ["lang", "used", "share", "pick"])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], precision: float = PRECISION) -> tuple[list[str], np.ndarray, np.ndarray, float, float]:
    """Classes, class scores of the buckets, bias, temperature and rejection score from (class, buckets, shares) rows."""
    classes = sorted({r[0] for r in rows})
    fit, held = [r for i, r in enumerate(rows) if i % 5], [r for i, r in enumerate(rows) if not i % 5]
    rng = np.random.default_rng(3)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    weight, bias = np.zeros((len(classes), DIM), np.float32), np.zeros(len(classes), np.float32)
    weight += rng.uniform(-0.1, 0.1, weight.shape).astype(np.float32)
    place = {c: i for i, c in enumerate(classes)}
    steps, done = EPOCHS * max(len(fit), 1), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(fit)):
            label, used, share = fit[i]
            rate = RATE * (1 - done / steps)
            mean = share @ table[used]
            error = _softmax(weight @ mean + bias)
            error[place[label]] -= 1
            pull = weight.T @ error
            weight -= rate * np.outer(error, mean)
            bias -= rate * 0.1 * error
            # shares are small: the step of a bucket is scaled by the root of the number of buckets used
            table[used] -= rate * np.float32(np.sqrt(len(used))) * share[:, None] * pull
            done += 1
    scores = (table @ weight.T).astype(np.float32)
    logits = np.array([share @ scores[used] + bias for _, used, share in held or fit])
    truth = np.array([place[r[0]] for r in held or fit])
    temperature = min((0.05 * 1.2**k for k in range(40)), key=lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean())
    p = _softmax(logits / temperature)
    order = np.argsort(-p.max(axis=1), kind="stable")
    right = np.cumsum(p.argmax(axis=1)[order] == truth[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(right >= precision)
    reject = float(p.max(axis=1)[order[good[-1]]]) if len(good) else 1.0
    return classes, scores, bias, float(temperature), min(reject, 1.0)


def _train_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["pick", "lang", "used"], ignore_index=True)
    rows = [(r.lang, np.frombuffer(r.used, np.uint16).astype(np.int64), np.frombuffer(r.share, np.float32)) for r in pdf.itertuples() if len(r.used)]
    if not rows:
        return pd.DataFrame({"classes": [[]], "scores": [b""], "bias": [b""], "temperature": [1.0], "reject": [1.0]})
    classes, scores, bias, temperature, reject = train(rows)
    return pd.DataFrame({"classes": [classes], "scores": [scores.tobytes()], "bias": [bias.tobytes()], "temperature": [temperature], "reject": [reject]})


@dataclass(frozen=True)
class Model:
    classes: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    reject: float


def fit(labelled: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """A model from labelled (doc_id, text, lang); about max_docs documents, chosen by a digest of doc_id, alike by language."""
    labelled = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    per_lang = materialize(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang-counts")
    each = max_docs / max(per_lang.count(), 1)
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    sample = labelled.join(per_lang, "lang").withColumn("pick", pick).where(F.col("pick") < F.least(F.lit(1.0), F.lit(float(each)) / F.col("n")))
    counts = sample.select("lang", "text", "pick").mapInArrow(_histograms, "lang string, used binary, share binary, pick double")
    made = counts.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(_train_group, "classes array<string>, scores binary, bias binary, temperature double, reject double").first()
    if made is None or not made["classes"]:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, 1.0)
    k = len(made["classes"])
    return Model(list(made["classes"]), np.frombuffer(made["scores"], np.float32).reshape(BUCKETS, k), np.frombuffer(made["bias"], np.float32), made["temperature"], made["reject"])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, accepted for every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.classes)
        columns = [np.ascontiguousarray(model.scores[:, j]) for j in range(k)]
        for batch in batches:
            n = batch.num_rows
            sums, counts = np.zeros((n, k)), np.zeros(n)
            for found, rows in subwords(batch.column(1)):
                if len(rows):
                    lo, hi = int(rows.min()), int(rows.max()) + 1
                    counts[lo:hi] += np.bincount(rows - lo, minlength=hi - lo)
                    for j in range(k):
                        sums[lo:hi, j] += np.bincount(rows - lo, weights=columns[j][found], minlength=hi - lo)
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            known = letters & (k > 0)
            p = _softmax((sums / np.maximum(counts, 1)[:, None] + model.bias) / model.temperature) if k else np.zeros((n, 1))
            names = np.array([*model.classes, UNDETERMINED], object)
            best = np.where(known, p.argmax(axis=1), k)
            score = np.where(known, p.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(score), pa.array(known & (score >= model.reject))], ["doc_id", "lang_pred", "score", "accepted"])

    letters: Column = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", letters.alias("letters")).mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")
