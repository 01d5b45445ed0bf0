"""Vectorised text kernels for Arrow batches: words, hashes and n-grams on UTF-8 bytes.

A word is a run of bytes outside space and 0x09-0x0D. All hashes are 64 bits: a
polynomial over random byte values modulo 2**64, taken from prefix sums, then mixed.
They depend on the content alone, so every executor gets the same ones.

Defined cases: null, empty and blank texts have no words; a text longer than a slice is a slice of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2_000_000
_BASE = 0x9E3779B97F4A7C15
_RING = 1 << 64
U64 = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(_BASE))


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**j and base**-j for j below n, modulo 2**64."""
    up = np.full(n, base, dtype=U64)
    down = np.full(n, pow(base, -1, _RING), dtype=U64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n).bit_length())
    up, down = _powers(size, base)
    return up[:n], down[:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[s:e] for each pair; equal content has equal hashes wherever it stands."""
    if not len(starts):
        return np.zeros(0, dtype=U64)
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * up[:-1], dtype=U64, out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def byte_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(_byte_values()[buf], starts, ends)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words, for every start; those near the end are dropped."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=U64)
    starts = np.arange(m)
    return span_hashes(words, starts, starts + n)


@lru_cache(maxsize=1)
def blank_table() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    return table


@lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    """Lower-cases A-Z only."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and len + 1 offsets; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return buf, offsets - offsets[0]


def give_back() -> None:
    """Free memory of this worker process goes back to the machine, so that an idle worker holds little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of words before it (len + 1)."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~blank_table()[buf]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(buf))]
    first[inner] = solid[inner]
    last = np.zeros(len(buf), dtype=bool)
    last[:-1] = solid[:-1] & (~solid[1:] | first[1:])
    last[-1] = solid[-1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def sliding(op: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """op over values[i:i + width] for every i with a whole window."""
    m = len(values) - width + 1
    if m <= 0:
        return values[:0]
    done, out = 1, values
    while done * 2 <= width:
        out = op(out[: len(out) - done], out[done:])
        done *= 2
    if done < width:
        rest = width - done
        out = op(out[:m], out[rest : rest + m])
    return out[:m]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0], ..., starts[0] + lengths[0] - 1, starts[1], ..."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)
