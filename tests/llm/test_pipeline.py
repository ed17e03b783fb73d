"""The pipeline's stages against brute force: clashing columns, repeated rows, nulls, ties, empty and long texts."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from plumbline.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, kept string, kept_id int, mix_id string, row string, digest int, row_hash string, length string, sequence_id string, text_length int"


def _rows():
    rng = random.Random(12)
    vocab = [f"word{i}" for i in range(500)]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(60, 160))) for _ in range(40)]
    texts += [re.sub(r"word\d+$", "changed", t) for t in texts[:10]] + texts[:6] + [t.upper() for t in texts[6:9]]
    texts += [None, None, "", " \n ", "short text", "spam spam spam " * 60, "# $ % & " * 40, " ".join(rng.choices(vocab, k=6000))]
    out = [(i, t, "en", f"s{i % 3}" if i % 7 else None) for i, t in enumerate(texts)]
    out += [out[0], out[0], out[12], (5, texts[20], "en", "s1"), (None, texts[3], None, None), (None, " ".join(rng.choices(vocab, k=80)), None, "s0")]
    return [(*r, f"k{i}", i, "m", "own", 3, "h", "len", "seq", 9) for i, r in enumerate(out)]


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _words(text):
    return [w.translate(LOWER) for w in WORD.findall(text or "")]


def _set(text):
    w = _words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def _good(text):
    w = WORD.findall(text or "")
    n = len(w)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    repeated = {k + j for k in range(n - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
    chars, lines = sum(map(len, w)), [x for x in (text or "").split("\n") if WORD.search(x)]
    letters = [c for c in text or "" if c.isalpha()]
    return not (
        n < 50 or 100 * len(repeated) > 50 * n or chars < 2 * n or chars > 14 * n or 10 * len(re.findall(r"[#*$%&|<>]", text or "")) > n
        or 2 * (len(lines) - len(set(lines))) > len(lines) or 2 * sum(c.isupper() for c in letters) > len(letters)
    )


def _key(r):
    return (r[0] is None, r[0] or 0, r[1] or "")


def test_quality_stage(spark, docs, rows):
    got = cp.keep_good(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted((r for r in rows if _good(r[1])), key=str)


def test_exact_stage(spark, docs, rows):
    got = cp.drop_copies(spark, docs, "")
    assert got.columns == docs.columns
    want = {}
    for r in rows:
        t = (r[1] or "").translate(LOWER)
        want[t] = max(want.get(t, -1), -1 if r[0] is None else r[0])
    found = [((r.text or "").translate(LOWER), -1 if r.doc_id is None else r.doc_id) for r in got.collect()]
    assert len(found) == len(want) and dict(found) == want
    assert {tuple(r) for r in got.collect()} <= set(rows)


def test_near_stage(spark, docs, rows):
    got = cp.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    sets = [_set(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = (rows[a][0], rows[a][1]) == (rows[b][0], rows[b][1])
            if same or (sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i])
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(groups)
    of = {r: find(i) for i, r in enumerate(rows)}
    assert {of[r] for r in found} == set(groups)
    for r in found:
        assert r[0] == min((x[0] for x in groups[of[r]] if x[0] is not None), default=None)


def test_mix_stage(spark, docs, rows):
    got = cp.mix_sources(spark, docs, "")
    assert got.columns == docs.columns
    copies = {}
    for r in mixing.mix(docs).collect():
        copies[(r.doc_id, r.source, r.size)] = r.copies
    want = Counter()
    for r in rows:
        want[r] += copies[(r[0], r[3], len(_words(r[1])))]
    assert Counter(map(tuple, got.collect())) == +want
    assert max(copies.values()) <= mixing.CAP
    for source in {r[3] for r in rows}:
        mine = [(r, len(_words(r[1]))) for r in rows if r[3] == source]
        target = mixing.mix(docs).where(F.col("source").eqNullSafe(F.lit(source))).first().target
        assert abs(sum(n * copies[(r[0], r[3], n)] for r, n in mine) - target) <= 2 * max(n for _, n in mine)


def test_pack_stage(spark, docs, rows):
    got = cp.pack_sequences(spark, docs, "").collect()
    assert sorted({-1 if r.doc_id is None else r.doc_id for r in got}) == sorted({-1 if r[0] is None else r[0] for r in rows})
    assert sum(r.piece == 0 for r in got) == len(rows)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        end = 0
        for at, n in sorted(b):
            assert at == end
            end += n
        assert end <= 1024


def test_empty_table(spark, docs):
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0


def test_run(spark, docs, rows, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = cp.run(spark, str(tmp_path)).collect()
    kept = {r[0] for r in rows if _good(r[1])}
    assert got and {r.doc_id for r in got} <= kept and all(0 < r.length <= 1024 for r in got)
