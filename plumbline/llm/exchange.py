"""Packed exchange of (hash, document, position) triples.

A map task sorts its triples by hash and sends one small binary row to each bucket instead of a
row for each triple: hashes as byte planes of their differences, ids and positions as byte planes.
Buckets are ranges of the hash, dealt evenly over the shuffle partitions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession

U = np.uint64
BUCKET_ITEMS = 400_000


def _murmur3_int(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's Murmur3 of an int column, which places rows of a hash exchange."""
    m = U(0xFFFFFFFF)

    def rotl(v, r):
        return ((v << U(r)) | (v >> U(32 - r))) & m

    k = (x.astype(U) * U(0xCC9E2D51)) & m
    k = (rotl(k, 15) * U(0x1B873593)) & m
    h = rotl(U(seed) ^ k, 13)
    h = (h * U(5) + U(0xE6546B64)) & m
    h ^= U(4)
    h ^= h >> U(16)
    h = (h * U(0x85EBCA6B)) & m
    h ^= h >> U(13)
    h = (h * U(0xC2B2AE35)) & m
    return (h ^ (h >> U(16))).astype(np.uint32).astype(np.int32).astype(np.int64)


def even_slots(spark: SparkSession, items: int) -> np.ndarray:
    """Keys of the buckets for about so many items: bucket b goes to partition b mod P, so that
    each partition gets as many buckets. The number of buckets follows the items alone."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rounds = max(1, -(-int(items) // (parts * BUCKET_ITEMS)))
    keys = np.arange(int(parts * (rounds * 1.5 + 14) * max(1, np.log2(parts + 1) / 4)), dtype=np.int64)
    place = np.mod(_murmur3_int(keys), parts)
    order = np.argsort(place, kind="stable")
    first = np.searchsorted(place[order], np.arange(parts))
    count = np.bincount(place, minlength=parts)
    if count.min() < rounds:  # a partition without enough keys: share what there is
        rounds = max(1, int(count.min()))
    return np.concatenate([keys[order[first + r]] for r in range(rounds)]).astype(np.int32)


def planes(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, low bytes first, without planes that are all zero."""
    values = np.ascontiguousarray(values, dtype="<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplanes(raw: bytes, n: int) -> np.ndarray:
    width = raw[0]
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(raw, dtype=np.uint8, offset=1, count=n * width).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def framed(ids: np.ndarray) -> bytes:
    """Signed integers as their least one and byte planes of what the others are above it."""
    least = int(ids.min()) if len(ids) else 0
    return least.to_bytes(8, "little", signed=True) + planes(ids.view(U) - np.array([least], dtype=np.int64).view(U))


def unframed(raw: bytes, n: int) -> np.ndarray:
    least = np.array([int.from_bytes(raw[:8], "little", signed=True)], dtype=np.int64)
    return (unplanes(raw[8:], n) + least.view(U)).view(np.int64)


def bucket_of(hashes: np.ndarray, buckets: int, bits: int = 64) -> np.ndarray:
    """Bucket by range of the hash: bits is its width."""
    top = (hashes >> U(max(0, bits - 32))) & U(0xFFFFFFFF)
    return ((top * U(buckets)) >> U(32)).astype(np.int64)


def pack_sorted(hashes: np.ndarray, ids: np.ndarray, others: list[np.ndarray], slots: np.ndarray, bits: int = 64):
    """Rows (slot, n, h, ids, c0, c1, ...) for hashes in ascending order with their companions."""
    cut = np.searchsorted(bucket_of(hashes, len(slots), bits), np.arange(len(slots) + 1))
    for b in np.flatnonzero(np.diff(cut)):
        i, j = cut[b], cut[b + 1]
        part = hashes[i:j]
        step = np.empty(j - i, dtype=U)
        step[0] = part[0]
        np.subtract(part[1:], part[:-1], out=step[1:])
        head = step[0]
        step[0] = 0
        yield (int(slots[b]), int(j - i), int(head).to_bytes(8, "little") + planes(step), framed(ids[i:j]), *(planes(o[i:j]) for o in others))


def unpack(n: int, h: bytes, ids: bytes, others: list[bytes]) -> tuple[np.ndarray, ...]:
    step = unplanes(h[8:], n).copy()
    step[0] = U(int.from_bytes(h[:8], "little"))
    return (np.cumsum(step, dtype=U), unframed(ids, n), *(unplanes(o, n) for o in others))
