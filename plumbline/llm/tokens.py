"""Encoding texts by distinct chunks.

A chunk is a run of white space and what follows it. Where a tokenizer never joins across such a cut,
the ids of a text are the ids of its chunks, so each distinct chunk is encoded once by the tokenizers
library and the ids of whole texts are gathered with numpy. The cache of chunks is bounded: when it is
full it starts anew, which costs time only.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np

from plumbline.llm import textscan as T

CACHE_CHUNKS = 400_000
BLANK = np.zeros(256, dtype=bool)
BLANK[0x20] = True


def chunk_cuts(data: np.ndarray, offsets: np.ndarray, space: np.ndarray, guard: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Starts of the chunks: document heads, and white space after a character that isn't.
    guard(data, cuts) says where a cut would part white space that the tokenizer may join."""
    n = len(data)
    blank = space[data]
    cut = np.zeros(n, dtype=bool)
    cut[1:] = blank[1:] & ~blank[:-1]
    at = np.flatnonzero(cut)
    cut[at[~guard(data, at)]] = False
    heads = offsets[:-1]
    cut[heads[heads < n]] = True
    return np.flatnonzero(cut)


def after_ascii_or_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """No cut after white space outside ASCII, which may be one token with what follows it."""
    one, two, three = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    narrow = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    wide = (three >= 0xE1) & (three <= 0xE3) & ((two == 0x9A) | (two == 0x80) | (two == 0x81))
    return ~(narrow | wide)


def after_no_marker(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """No cut after a literal U+2581, which stands for white space itself."""
    return ~((data[at - 1] == 0x81) & (data[np.maximum(at - 2, 0)] == 0x96) & (data[np.maximum(at - 3, 0)] == 0xE2))


Spans = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the spans one after the other, and where each ends in them."""
    counts = end - start
    ends = np.cumsum(counts)
    return data[np.repeat(start - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)], ends


def one_by_one(encode: Callable[[list[str]], list[list[int]]]) -> Spans:
    """Encodes each span as a string of its own."""

    def run(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        joined, ends = gather(data, start, end)
        raw = joined.tobytes()
        ids = encode([raw[i:j].decode() for i, j in zip((ends - (end - start)).tolist(), ends.tolist())])
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((x for y in ids for x in y), np.int32, int(counts.sum())), counts

    return run


def together(encode: Callable[[list[str]], list[list[int]]], width: np.ndarray, space: np.ndarray, guard, piece: int = 1 << 15) -> Spans:
    """Encodes runs of spans as one string, where the tokenizer splits between them anyway: each starts
    with white space and follows a span that doesn't end with it. width: bytes of each id's token, by
    which the ids of a run are told apart. Other spans are encoded one by one."""
    alone = one_by_one(encode)

    def run(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        free = space[data[start]] & ~space[data[end - 1]] & guard(data, end)
        if not free.any():
            return alone(data, start, end)
        joined, ends = gather(data, start[free], end[free])
        marks = np.unique(np.append(np.searchsorted(ends, np.arange(piece, ends[-1] + 1, piece)), len(ends) - 1))
        cuts = ends[marks].tolist()
        raw = joined.tobytes()
        flat = np.concatenate([np.array(x, dtype=np.int32) for x in encode([raw[i:j].decode() for i, j in zip([0, *cuts[:-1]], cuts)])])
        reach = np.cumsum(width[flat])
        last = np.searchsorted(reach, ends)
        if last[-1] >= len(reach) or not np.array_equal(reach[last], ends):
            return alone(data, start, end)  # a token that isn't as wide as its text
        counts = np.zeros(len(start), np.int64)
        counts[free] = np.diff(last, prepend=-1)
        if free.all():
            return flat, counts
        rest, some = alone(data, start[~free], end[~free])
        counts[~free] = some
        out = np.empty(int(counts.sum()), np.int32)
        mine = np.repeat(free, counts)
        out[mine], out[~mine] = flat, rest
        return out, counts

    return run


class ChunkCoder:
    """Ids of texts from the ids of their chunks. A direct-mapped table keeps chunks that were seen; one
    that another has pushed out is encoded again."""

    def __init__(self, encode: Spans, space: np.ndarray, guard, most: int | None = None, bits: int = 20):
        """most: chunks that it keeps, CACHE_CHUNKS by default; bits: of the number of places in its table."""
        self.encode, self.space, self.guard, self.most, self.bits = encode, space, guard, most, bits
        self.reset()

    def reset(self) -> None:
        self.key = np.zeros(1 << self.bits, np.uint64)
        self.value = np.zeros(1 << self.bits, np.int32)
        self.start, self.count, self.pool = (np.zeros(1 << 16, t) for t in (np.int64, np.int32, np.int32))
        self.chunks = self.used = 0

    def _add(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        n, m, total = self.chunks, len(counts), len(ids)
        if n + m > len(self.start):
            size = max(2 * len(self.start), n + m)
            self.start, self.count = np.resize(self.start, size), np.resize(self.count, size)
        if self.used + total > len(self.pool):
            self.pool = np.resize(self.pool, max(2 * len(self.pool), self.used + total))
        self.pool[self.used : self.used + total] = ids
        self.count[n : n + m] = counts
        self.start[n : n + m] = self.used + np.cumsum(counts) - counts
        self.chunks, self.used = n + m, self.used + total
        return np.arange(n, n + m, dtype=np.int32)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the len+1 offsets of the texts in them."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        if self.chunks > (CACHE_CHUNKS if self.most is None else self.most):
            self.reset()
        start = chunk_cuts(data, offsets, self.space, self.guard)
        end = np.append(start[1:], len(data))
        hashes = T.span_hashes(data, start, end)
        place = (hashes & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        slot = self.value[place]
        missing = np.flatnonzero(self.key[place] != hashes)
        if len(missing):
            new, first, inverse = np.unique(hashes[missing], return_index=True, return_inverse=True)
            at = missing[first]
            index = self._add(*self.encode(data, start[at], end[at]))
            slot[missing] = index[inverse]
            self.key[place[at]], self.value[place[at]] = new, index
        counts = self.count[slot].astype(np.int64)
        ends = np.cumsum(counts)
        flat = self.pool[np.repeat(self.start[slot] - (ends - counts), counts) + np.arange(ends[-1])]
        before = np.append(0, ends)
        return flat, before[np.searchsorted(start, offsets, side="left")]


def threads(n: int) -> None:
    """For the tokenizers library, before its first batch in this process."""
    os.environ.setdefault("RAYON_NUM_THREADS", str(n))
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true" if n > 1 else "false")
