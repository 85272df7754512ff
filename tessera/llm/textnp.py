"""Vectorised words, hashes and n-grams over Arrow text, without a Python loop per word.

A word is a run of bytes other than space, tab, LF, VT, FF and CR, that is
``[^\\x20\\x09-\\x0D]+``; in UTF-8 these bytes occur only as those characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tessera.scratch import ship

ship(__name__)

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BASE = U64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    if n:
        out[0] = U64(1)
    return np.multiply.accumulate(out) if n else out


def batches(column: pa.Array, most_bytes: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices [a, b) of a string column as (a, b, bytes, offsets), each about most_bytes or one text. Nulls count as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most_bytes, "right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text the index of its first word (one more entry than texts)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    full = offsets[1:] > offsets[:-1]
    at = offsets[:-1][full]
    first[at] = solid[at]
    at = offsets[1:][full] - 1
    last[at] = solid[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, slice_bytes: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each word's bytes, in slices that bound memory."""
    out = np.empty(len(starts), dtype=U64)
    if not len(starts):
        return out
    lengths = ends - starts
    total = np.concatenate(([0], np.cumsum(lengths)))
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(total, total[a] + slice_bytes, "right")) - 1)
        before = total[a:b] - total[a]
        size = int(total[b] - total[a])
        within = np.arange(size) - np.repeat(before, lengths[a:b])
        letters = raw[within + np.repeat(starts[a:b], lengths[a:b])].astype(U64) + U64(1)
        table = powers(int(lengths[a:b].max()), BASE)
        out[a:b] = np.add.reduceat(letters * table[within], before)
        a = b
    return mix(out ^ (lengths.astype(U64) << U64(40)))


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct k-word shingles; a text of 1 to k-1 words has one, of all its words; an empty text has none."""
    n = len(hashes)
    if n >= k:
        rolled = np.zeros(n - k + 1, dtype=U64)
        for i in range(k):
            rolled = mix(rolled + U64(i + 1)) + hashes[i : n - k + 1 + i]
        rolled = mix(rolled)
    else:
        rolled = np.zeros(0, dtype=U64)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(rolled[a : b - k + 1])
        elif b > a:
            whole = np.uint64(b - a)
            for h in hashes[a:b]:
                whole = mix(np.array([whole], dtype=U64) + h)[0]
            yield np.array([whole], dtype=U64)
        else:
            yield np.zeros(0, dtype=U64)
