"""Vectorised helpers over the UTF-8 bytes of Arrow text columns."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Multiplier of the polynomial hash (odd, so that it has an inverse modulo 2**64).
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that one vectorised step handles; a single longer text is a step of its own.
STEP_BYTES = 500_000


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the 64 output bits (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def give_back() -> None:
    """Hand freed memory back to the system at the end of a task: workers live on, and the next stage's stand beside them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def text_steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``limit`` bytes; null texts are empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    _, offsets, data = col.buffers()
    n = len(col)
    if n == 0:
        return
    at = np.frombuffer(offsets, dtype=np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(at, at[first] + limit, side="right")) - 1
        end = min(n, max(end, first + 1))
        lo, hi = int(at[first]), int(at[end])
        yield first, end, raw[lo:hi], at[first : end + 1] - lo
        first = end


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the words ``[^\\x20\\x09-\\x0D]+`` of each text."""
    if len(data) == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    heads = np.zeros(len(data) + 1, bool)
    heads[offsets] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | heads[1:-1]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | heads[1:-1]
    s = np.flatnonzero(start)
    e = np.flatnonzero(stop) + 1
    row = np.searchsorted(offsets, s, side="right") - 1
    return s, e, row


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n; kept for the usual step size only."""
    size = STEP_BYTES + 1 if n <= STEP_BYTES + 1 else n
    if size in _POWERS:
        p = _POWERS[size]
    else:
        p = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, np.uint64(b))]), dtype=np.uint64) for b in (BASE, BASE_INVERSE))
        if size == STEP_BYTES + 1:
            _POWERS[size] = p
    return p[0][:n], p[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] = sum of (byte + 1) * BASE**i over i in [s, e)."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes [s, e), equal for equal bytes wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[e] - prefix[s]) * down[s] + np.uint64(0x632BE59BD9B4E019) * (e - s).astype(np.uint64))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    out = data.copy()
    out[(out >= 65) & (out <= 90)] += 32
    return out


def shingles(words: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``width`` words of a row; the whole sequence where a row has fewer words."""
    counts = np.bincount(rows, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    if len(words) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    left = counts[rows] - (np.arange(len(rows)) - first[rows])
    full = np.flatnonzero(left >= width)
    h = np.zeros(len(full), np.uint64)
    for k in range(width):
        h = mix(h * np.uint64(BASE) + words[full + k])
    short = np.flatnonzero((counts > 0) & (counts < width))
    extra = np.zeros(len(short), np.uint64)
    for k in range(width - 1):
        has = counts[short] > k
        extra[has] = mix(extra[has] * np.uint64(BASE) + words[first[short[has]] + k])
    extra = mix(extra + counts[short].astype(np.uint64))
    return np.concatenate([rows[full], short]), np.concatenate([h, extra])


def distinct_in_row(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by (row, hash), each pair once."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[keep], hashes[keep]
