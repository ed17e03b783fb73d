"""Word and shingle hashes of whole texts, computed with numpy over the bytes of Arrow string columns.

A word's hash is a polynomial of its bytes (A-Z lower-cased) modulo 2**64, mixed; a shingle's is a mixed linear form of
its five word hashes. Work goes in slices of about SLICE bytes that end at a word's end, so memory does not grow with
the length of a text beyond eight bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE = 1 << 16
WIDTH = 5

_SEP = np.zeros(256, bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTES = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))[_LOWER]
_PLACE = mix(np.arange(1, WIDTH + 1, dtype=U64)) | U64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(2 * SLICE, 1 << max(1, (n - 1).bit_length()))
    if size not in _cache:
        if size > 2 * SLICE:  # a word of this length is rare: do not keep its tables
            return _powers(_BASE, size), _powers(_INVERSE, size)
        _cache[size] = (_powers(_BASE, size), _powers(_INVERSE, size))
    return _cache[size]


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its offsets (rows + 1); nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word of data."""
    solid = ~_SEP[data]
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    edges = offs[(offs > 0) & (offs < len(data))]
    start[edges] = solid[edges]
    end[edges - 1] = solid[edges - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offs[1:], starts, "right")


def _hash_slice(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, doc = words(data, offs)
    up, down = _tables(len(data))
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTES[data] * up[: len(data)], dtype=U64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), doc


def word_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, hashes, row of each hash less the first) for runs of whole rows, in order."""
    data, offs = string_bytes(column)
    row, n = 0, len(offs) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(offs, offs[row] + SLICE, "right")) - 1)
        text, here = data[offs[row] : offs[last]], offs[row : last + 1] - offs[row]
        if last == row + 1 and len(text) > 2 * SLICE:
            hashes = np.concatenate([_hash_slice(t, np.array([0, len(t)]))[0] for t in _cuts(text)])
            yield row, 1, hashes, np.zeros(len(hashes), np.int64)
        else:
            yield row, last - row, *_hash_slice(text, here)
        row = last


def _cuts(text: np.ndarray) -> Iterator[np.ndarray]:
    at = 0
    while at < len(text):
        stop = min(len(text), at + SLICE)
        while stop < len(text):
            found = np.flatnonzero(_SEP[text[stop : stop + SLICE]])
            if len(found):
                stop += int(found[0])
                break
            stop = min(len(text), stop + SLICE)
        yield text[at:stop]
        at = stop


def by_owner(values: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """The order by owner, then value; a quick sort and a counting sort beat one sort by two keys."""
    first = np.argsort(values)
    return first[np.argsort(owner[first].astype(np.uint16 if rows <= 1 << 16 else np.int64), kind="stable")]


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sizes, values) for runs of rows: each row's distinct shingles, ascending, one row after the other.

    Fewer than five words make one shingle of the whole sequence; no words make an empty set.
    """
    for first, rows, h, doc in word_hashes(column):
        n_words = np.bincount(doc, minlength=rows)
        linear = np.zeros(len(h), U64)
        fits = np.zeros(len(h), bool)
        if len(h) >= WIDTH:
            m = len(h) - WIDTH + 1
            fits[:m] = doc[:m] == doc[WIDTH - 1 :]
            for j in range(WIDTH):
                linear[:m] += h[j : j + m] * _PLACE[j]
        values, owner = mix(linear[fits]), doc[fits]
        short = np.flatnonzero((n_words > 0) & (n_words < WIDTH))
        if len(short):
            begin = np.searchsorted(doc, short)
            whole = np.array([sum(int(x) * int(p) for x, p in zip(h[b : b + n_words[r]], _PLACE, strict=False)) + int(n_words[r]) * _BASE & (1 << 64) - 1 for b, r in zip(begin, short, strict=True)], dtype=U64)
            values, owner = np.concatenate([values, mix(whole)]), np.concatenate([owner, short])
        order = by_owner(values, owner, rows)
        values, owner = values[order], owner[order]
        fresh = np.ones(len(values), bool)
        fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        values, owner = values[fresh], owner[fresh]
        yield first, np.bincount(owner, minlength=rows), values
