"""Vectorised reading of Arrow text columns: words, hashes of words and of word windows.

All functions work on the bytes of many documents at once, in slices of bounded size, so that
memory does not follow the partition. A single document above the bound is a slice of its own.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Just below a power of two, as tables of powers are made for the next one.
SLICE_BYTES = (1 << 19) - 1
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
BASE_BYTE = 0x9E3779B97F4A7C15 | 1
BASE_WORD = 0xC2B2AE3D27D4EB4F | 1
#: Bases of second hashes, which have nothing in common with the first.
SECOND_BYTE = 0xD1B54A32D192ED03 | 1
SECOND_WORD = 0xAEF17502108EF2D9 | 1
U = np.uint64
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n; grown on demand."""
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            out = np.full(size, b, dtype=U)
            out[0] = 1
            both.append(np.multiply.accumulate(out))
        have = _tables[base] = (both[0], both[1])
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def tidy(cycles: bool = False) -> None:
    """Gives freed memory back to the system: workers live on after a task. cycles: objects that refer to
    one another are freed first."""
    if cycles:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and len+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slices(column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of at most limit bytes."""
    data, offsets = text_buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_bounds(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each run of bytes that aren't in space, by default the words
    [^\\x20\\x09-\\x0D]+; no run crosses documents."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~space[data]
    heads = offsets[:-1]
    heads = heads[heads < n]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[heads] = False
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[heads[heads > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE_BYTE) -> np.ndarray:
    """64-bit hash of each byte span, the same wherever the span stands."""
    if not len(start):
        return np.zeros(0, U)
    up, down = powers(base, len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=U)
    np.multiply(data, up[: len(data)], out=total[1:])
    np.cumsum(total[1:], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def window_hashes(words: np.ndarray, doc: np.ndarray, length: int, salt: int = 0, base: int = BASE_WORD) -> tuple[np.ndarray, np.ndarray]:
    """First word index and hash of each run of length words that lies in one document."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    up, down = powers(base, len(words) + 1)
    total = np.zeros(len(words) + 1, dtype=U)
    np.cumsum(words * up[: len(words)], out=total[1:])
    first = np.flatnonzero(doc[:n] == doc[length - 1 :])
    return first, mix((total[first + length] - total[first]) * down[first] + U((length * 0xA0761D6478BD642F + salt * 0xE7037ED1A0B428DB) % (1 << 64)))


def doc_starts(doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Index of the first word of each document, and the end: n_docs + 1 numbers."""
    return np.searchsorted(doc, np.arange(n_docs + 1), side="left")
