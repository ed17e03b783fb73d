"""Static binary-fuse filter over 64-bit keys: built once for an immutable key set, 16-bit fingerprints.

Three probes per key into a table of about 1.13 cells a key for large sets; a key of the set is always found, another
one is let through with probability 2**-16. Built and probed with numpy; peeling runs in rounds over all singleton cells.
"""

from __future__ import annotations

import math

import numpy as np

U64 = np.uint64


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(U64) + U64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _cells(mixed: np.ndarray, seg_len: int, seg_count: int) -> np.ndarray:
    mask = U64(seg_len - 1)
    first = ((mixed >> U64(32)) * U64(seg_len * seg_count)) >> U64(32)
    second = (first + U64(seg_len)) ^ ((mixed >> U64(18)) & mask)
    third = (first + U64(2 * seg_len)) ^ (mixed & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _prints(mixed: np.ndarray) -> np.ndarray:
    return (mixed ^ (mixed >> U64(32)) ^ (mixed >> U64(47))).astype(np.uint16)


def build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segment count, table). Repeated keys count once; no keys give an empty table."""
    keys = np.unique(keys.astype(U64))
    n = len(keys)
    if n == 0:
        return 0, 0, 0, b""
    seg_len = min(1 << 18, 1 << max(2, int(math.floor(math.log(n + 1) / math.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    seg_count = max(1, math.ceil(n * factor / seg_len) - 2)
    for seed in range(1, 200):
        if seed % 20 == 0:
            seg_count += max(1, seg_count // 4)
        mixed = _mix(keys, seed)
        cells = _cells(mixed, seg_len, seg_count)
        size = (seg_count + 2) * seg_len
        order = _peel(cells, size, n)
        if order is None:
            continue
        table, prints = np.zeros(size, np.uint16), _prints(mixed)
        for who, slot in reversed(order):
            c = cells[:, who]
            table[c[slot, np.arange(len(who))]] = 0
            table[c[slot, np.arange(len(who))]] = prints[who] ^ table[c[0]] ^ table[c[1]] ^ table[c[2]]
        return seed, seg_len, seg_count, table.tobytes()
    raise RuntimeError("no seed lets the filter be peeled")


def _peel(cells: np.ndarray, size: int, n: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, which of the three cells is theirs alone), or None if a core is left."""
    degree = np.bincount(cells.ravel(), minlength=size)
    folded = np.zeros(size, np.int64)
    for c in cells:
        np.bitwise_xor.at(folded, c, np.arange(n))
    order, left, alive = [], n, np.ones(n, bool)
    touched = np.arange(size)
    while left:
        single = touched[degree[touched] == 1]
        who = np.unique(folded[single])
        who = who[alive[who]]
        if len(who) == 0:
            return None
        own = degree[cells[:, who]] == 1
        slot = own.argmax(axis=0)
        order.append((who, slot))
        alive[who] = False
        for c in cells[:, who]:
            np.subtract.at(degree, c, 1)
            np.bitwise_xor.at(folded, c, who)
        left -= len(who)
        touched = np.unique(cells[:, who])
    return order


def contains(keys: np.ndarray, seed: int, seg_len: int, seg_count: int, table: bytes) -> np.ndarray:
    if seg_count == 0:
        return np.zeros(len(keys), bool)
    cells_of = np.frombuffer(table, np.uint16)
    mixed = _mix(keys.astype(U64), seed)
    c = _cells(mixed, seg_len, seg_count)
    return (_prints(mixed) ^ cells_of[c[0]] ^ cells_of[c[1]] ^ cells_of[c[2]]) == 0
