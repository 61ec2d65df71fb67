"""Vectorised word kernel shared by the text operators.

Texts arrive as Arrow string columns.  Their UTF-8 bytes are handled as one
NumPy array per block of rows, so splitting into words, hashing words and
hashing runs of words cost a few passes over the bytes and no Python object per
word.  All hashes are 64 bits wide: a random value per byte, a polynomial over
the bytes of a word (mod 2**64, odd base) and a final avalanche step.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE = 1 << 20          # bytes hashed at once
BLOCK = 1 << 21          # bytes of text handed to an operator at once

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """Avalanche step (the public splitmix64 finaliser)."""
    x = np.array(x, dtype=np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=4)
def _byte_values(lower: bool) -> np.ndarray:
    values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    if lower:
        values[65:91] = values[97:123]
    return values


_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse mod 2**64, up to n."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, PIECE + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


@lru_cache(maxsize=8)
def byte_class(kind: str) -> np.ndarray:
    """True for the bytes that belong to a word of this kind.

    ``space``: everything but ASCII white space, ``[^\\x20\\x09-\\x0D]``.
    ``alnum``: digits, ASCII letters and every non-ASCII byte,
    ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z.
    ``line``: everything but the newline.
    """
    table = np.ones(256, dtype=bool)
    if kind == "space":
        table[[0x20, *range(0x09, 0x0E)]] = False
    elif kind == "alnum":
        table[:128] = False
        table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = True
    elif kind == "line":
        table[0x0A] = False
    else:
        raise ValueError(kind)
    return table


def blocks(batch: pa.RecordBatch, column: str = "text",
           limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of consecutive rows of about ``limit`` bytes.

    Null texts count as empty.  A single text over the limit is a block of its own.
    """
    col = batch.column(column)
    if pa.types.is_large_string(col.type):
        width = np.int64
    else:
        col, width = col.cast(pa.string()), np.int32
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=width)[col.offset:col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, raw[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]
        first = end


def spans(data: np.ndarray, offsets: np.ndarray, kind: str = "space") -> tuple[np.ndarray, np.ndarray]:
    """Byte spans (start, end) of all words; no word crosses a row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = byte_class(kind)[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    before = edges - 1
    ends[before] = inside[before]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each span; spans are in order and do not overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    values = _byte_values(lower)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = int(np.searchsorted(ends, base + PIECE, side="right"))
        j = max(j, i + 1)
        stop = ends[j - 1]
        up, down = _power_tables(int(stop - base) + 1)
        run = np.empty(stop - base + 1, dtype=np.uint64)
        run[0] = 0
        np.cumsum(values[data[base:stop]] * up[:stop - base], out=run[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (run[e] - run[s]) * down[s] + (e - s).astype(np.uint64) * _STEP
        i = j
    return mix64(out)


def words(data: np.ndarray, offsets: np.ndarray, kind: str = "space",
          lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word and, per row, the range of its words."""
    starts, ends = spans(data, offsets, kind)
    return span_hashes(data, starts, ends, lower), starts, ends, np.searchsorted(starts, offsets)


def runs(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k consecutive words within a row, and the index of their first word."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n - k + 1, dtype=np.uint64)
    factor = 1
    for j in range(k):
        total += hashes[j:n - k + 1 + j] * np.uint64(factor)
        factor = factor * int(_STEP) % (1 << 64)
    row_end = np.repeat(bounds[1:], np.diff(bounds))
    first = np.flatnonzero(np.arange(n - k + 1) + k <= row_end[:n - k + 1])
    return mix64(total[first]), first


def row_of(positions: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Row that holds each position."""
    return np.searchsorted(bounds, positions, side="right") - 1


def per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of flags in each row's range."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs more than once."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(len(keys), dtype=bool)
    if len(keys) > 1:
        equal = ranked[1:] == ranked[:-1]
        same[1:] |= equal
        same[:-1] |= equal
    out = np.empty(len(keys), dtype=bool)
    out[order] = same
    return out


def in_row(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Keys equal only for equal hashes of the same row."""
    return mix64(hashes + (rows.astype(np.uint64) + np.uint64(1)) * _BASE)


def distinct_in_rows(hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row, end to end, and the rows' ranges; rows are in order."""
    h = hashes.copy()
    edges = np.searchsorted(rows, np.arange(n_rows + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a > 1:
            h[a:b].sort()
    keep = np.ones(len(h), dtype=bool)
    if len(h) > 1:
        keep[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    total = np.zeros(len(h) + 1, dtype=np.int64)
    np.cumsum(keep, out=total[1:])
    return h[keep], total[edges]
