"""Substring dedup by level-wise doubling.

Windows of a short length are compared first; only windows that repeat, and whose second half
repeats too, are extended to twice the length (for an odd length the halves share a word), until the asked
length is reached or no candidates survive. The last level compares hashes of 128 bits. Each level is one packed exchange of (hash, document, start): a bucket sees every
occurrence of its hashes, but a block of input sends one occurrence of a hash only, so a passage
that stands in a third of all documents adds one entry for each block.

Defined cases: null or blank texts have no words. A null id counts as the smallest id. Rows that
share an id count as one document: equal starts are the same start, so repeated rows are not removed
because of each other. Texts of any length are read whole. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import exchange as X
from plumbline.llm import textscan as T
from plumbline.llm.workspace import Workspace, local_rows

BLOCK_WINDOWS = 500_000
NO_ID = -(1 << 63)
#: Hashes of the levels before the last only filter, so they may be shorter: so many bits more than the
#: number of windows has, which lets one in 1024 pass by chance. That one is found out at the next level,
#: which uses hashes of its own, of two times 64 bits at the end.
SPARE_BITS = 10
PACKED = "slot int, n long, h binary, d binary, p binary, m binary, g binary, k long, kd binary, kp binary"
BY_DOC = "slot int, n long, d binary, p binary"
STARTS = "id long, starts binary"


def id_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def level_lengths(window: int, least: int = 8) -> list[int]:
    """Lengths up to window, each at most twice the one before it, from the shortest that is at least `least`; two
    at least, if window has two words."""
    lengths = [window]
    while lengths[0] > 1 and (len(lengths) == 1 or -(-lengths[0] // 2) >= least):
        lengths.insert(0, -(-lengths[0] // 2))
    return lengths


def encode_starts(starts: np.ndarray) -> bytes:
    """Ascending word indices as byte planes of their differences, after their number."""
    return len(starts).to_bytes(8, "little") + X.planes(np.diff(starts, prepend=0).astype(np.uint64))


def decode_starts(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    return np.cumsum(X.unplanes(raw[8:], n)).astype(np.int64)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


_PACKED = (["slot", "n", "h", "d", "p", "m", "g", "k", "kd", "kp"], [pa.int32(), pa.int64(), *[pa.binary()] * 5, pa.int64(), pa.binary(), pa.binary()])
_BY_DOC = (["slot", "n", "d", "p"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()])


def _groups(new: np.ndarray, d: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows ordered by hash, where new marks the first of each hash: whether each row's hash stands more
    than once, and whether the row is the first of its hash by (document, start)."""
    n = len(new)
    group = np.cumsum(new) - 1
    many = np.bincount(group)[group] > 1 if n else np.zeros(0, bool)
    first = ~many
    rows = np.flatnonzero(many)
    if len(rows):
        rows = rows[np.lexsort((p[rows], d[rows], group[rows]))]
        head = np.ones(len(rows), dtype=bool)
        head[1:] = group[rows[1:]] != group[rows[:-1]]
        # rows that share the very id and start are one occurrence
        same = np.zeros(len(rows), dtype=bool)
        at = np.maximum.accumulate(np.where(head, np.arange(len(rows)), 0))
        same = (d[rows] == d[rows[at]]) & (p[rows] == p[rows[at]])
        first[rows[same]] = True
    return many, first


def _ordered(h: np.ndarray, g: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by hash (and second hash), and which rows then start a hash."""
    if g is None:
        order = np.argsort(h, kind="stable")
        new = np.append(True, h[order][1:] != h[order][:-1]) if len(h) else np.zeros(0, bool)
        return order, new
    order = np.lexsort((g, h))
    x, y = h[order], g[order]
    return order, np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])) if len(h) else np.zeros(0, bool)


def _emit(length: int, half: int, bits: int, slots: np.ndarray, survivors: bool, last: bool):
    """Map side of a level: (id, text[, starts]) to packed windows, a block at a time."""

    def flush(parts: list[tuple[np.ndarray, ...]], turn: int) -> pa.RecordBatch:
        h, d, p = (np.concatenate([x[i] for x in parts]) for i in range(3))
        g = np.concatenate([x[3] for x in parts]) if last else None
        order, new = _ordered(h, g)
        h, d, p = h[order], d[order], p[order]
        many, first = _groups(new, d, p)
        one = first.copy()
        if many.any():  # of rows that are one occurrence, one is sent
            rows, group = np.flatnonzero(first & many), np.cumsum(new)
            one[rows[1:][group[rows[1:]] == group[rows[:-1]]]] = False
        known = ~first
        others = [p[one].astype(np.uint64), many[one].astype(np.uint64), *([g[order][one]] if last else [])]
        rows = [(*x, *(() if last else (b"",)), 0, b"", b"") for x in X.pack_sorted(h[one], d[one], others, slots, bits)]
        if known.any():
            order = np.lexsort((p[known], d[known]))
            rows.append((int(slots[turn % len(slots)]), 0, b"", b"", b"", b"", b"", int(known.sum()), X.framed(d[known][order]), X.planes(p[known][order].astype(np.uint64))))
        return _batch(rows, *_PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        turn, parts, held = TaskContext.get().partitionId() * 7919, [], 0
        mask = np.uint64((1 << bits) - 1)
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for i, j, data, offs in T.slices(batch.column("text")):
                start, end, doc = T.word_bounds(data, offs)
                words = T.span_hashes(data, start, end)
                at, h = T.window_hashes(words, doc, length, salt=bits)
                if not len(at):
                    continue
                head = T.doc_starts(doc, j - i)
                if survivors:
                    alive = np.zeros(len(words) + 1, dtype=bool)
                    for k, raw in enumerate(batch.column("starts").slice(i, j - i).to_pylist()):
                        if raw:
                            s = decode_starts(raw) + head[k]
                            alive[s[s < head[k + 1]]] = True
                    good = alive[at] & alive[np.minimum(at + length - half, len(words))]
                    if last and good.any():
                        g = T.window_hashes(T.span_hashes(data, start, end, T.SECOND_BYTE), doc, length, base=T.SECOND_WORD)[1][good]
                    at, h = at[good], h[good]
                elif last:
                    g = T.window_hashes(T.span_hashes(data, start, end, T.SECOND_BYTE), doc, length, base=T.SECOND_WORD)[1]
                if not len(at):
                    continue
                d = doc[at]
                parts.append((h & mask, ids[i:j][d], at - head[d], *([g] if last else [])))
                held += len(at)
                if held >= BLOCK_WINDOWS:
                    yield flush(parts, turn)
                    parts, held, turn = [], 0, turn + 1
                    T.tidy()
        if held:
            yield flush(parts, turn)
        parts = []
        T.tidy()

    return run


def _decide(later_only: bool, slots: np.ndarray):
    """Reduce side of a level: the occurrences of hashes that repeat (or all but the first)."""

    def run(table: pa.Table) -> pa.Table:
        h, d, p, m, g, out_d, out_p = [], [], [], [], [], [], []
        for row in table.to_pylist():
            if row["n"]:
                a, b, c, e, *f = X.unpack(row["n"], row["h"], row["d"], [row["p"], row["m"], *([row["g"]] if row["g"] else [])])
                h.append(a), d.append(b), p.append(c), m.append(e), g.extend(f)
            if row["k"]:
                out_d.append(X.unframed(row["kd"], row["k"])), out_p.append(X.unplanes(row["kp"], row["k"]))
        if h:
            h, d, p, m = (np.concatenate(x) for x in (h, d, p, m))
            order, new = _ordered(h, np.concatenate(g) if g else None)
            d, p, m = d[order], p[order], m[order]
            many, first = _groups(new, d, p)
            if later_only:
                hit = ~first
            else:  # a row that several rows of one document share isn't a repeat
                group = np.cumsum(new) - 1
                hit = (np.bincount(group, weights=~first)[group] > 0) | (m > 0)
            out_d.append(d[hit]), out_p.append(p[hit])
        rows = []
        if out_d:
            d, p = np.concatenate(out_d), np.concatenate(out_p)
            place = X.bucket_of(T.mix(d.view(np.uint64)), len(slots))
            order = np.lexsort((p, d, place))
            d, p, place = d[order], p[order], place[order]
            cut = np.searchsorted(place, np.arange(len(slots) + 1))
            rows = [(int(slots[b]), int(cut[b + 1] - cut[b]), X.framed(d[cut[b] : cut[b + 1]]), X.planes(p[cut[b] : cut[b + 1]])) for b in np.flatnonzero(np.diff(cut))]
        del h, d, p, m, g, out_d, out_p
        T.tidy()
        return pa.Table.from_batches([_batch(rows, *_BY_DOC)])

    return run


def _by_document(table: pa.Table) -> pa.Table:
    got = [(X.unframed(r["d"], r["n"]), X.unplanes(r["p"], r["n"])) for r in table.to_pylist()]
    d, p = (np.concatenate(x) for x in zip(*got))
    order = np.lexsort((p, d))
    d, p = d[order], p[order]
    cut = np.append(np.flatnonzero(np.append(True, d[1:] != d[:-1])), len(d))
    ids = d[cut[:-1]]
    return pa.table({"id": pa.array(ids, pa.int64()), "starts": pa.array([encode_starts(np.unique(p[i:j]).astype(np.int64)) for i, j in zip(cut[:-1], cut[1:])], pa.binary())})


def text_size(docs: DataFrame) -> int:
    """Bytes of all texts, which set the number of buckets."""
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def repeated_starts(docs: DataFrame, length: int, half: int, alive: DataFrame | None, items: int, later_only: bool, last: bool) -> DataFrame:
    """(id, starts) of the windows of this length that stand more than once; with later_only, of
    those that also start earlier. alive: the starts that survived at the length half, of which two cover the window."""
    slots = X.even_slots(docs.sparkSession, items)
    source = docs if alive is None else docs.join(alive, "id")
    bits = 64 if last else min(64, items.bit_length() + SPARE_BITS)
    packed = source.mapInArrow(_emit(length, half, bits, slots, alive is not None, last), PACKED)
    found = packed.groupBy("slot").applyInArrow(_decide(later_only, slots), BY_DOC)
    return found.groupBy("slot").applyInArrow(_by_document, STARTS)


def removal_starts(docs: DataFrame, work: Workspace, window: int = 20) -> DataFrame:
    """(id, starts): windows of `window` words whose words also start earlier. docs: id, text."""
    items = text_size(docs) // 6 + 1
    lengths, alive, half = level_lengths(window), None, 0
    for length in lengths[:-1]:
        alive = work.save(lambda length=length, half=half, alive=alive: repeated_starts(docs, length, half, alive, items, False, False), f"level{length}")
        if alive.isEmpty():
            return alive
        half = length
    return work.save(lambda: repeated_starts(docs, window, half, alive, items, True, True), "later")


def longest_repeats(docs: DataFrame, start: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, length) of the longest doubled length at which a document still shares a window:
    levels go on until no candidates survive."""
    work = Workspace(docs.sparkSession, "longest")
    docs = docs.select(id_of(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    items, alive, length, found = text_size(docs) // 6 + 1, None, start, None
    while True:
        alive = work.save(lambda length=length, alive=alive: repeated_starts(docs, length, length // 2, alive, items, False, True), f"level{length}")
        if alive.isEmpty():
            break
        level = alive.select("id", F.lit(length).cast("long").alias("length"))
        found = level if found is None else found.unionByName(level)
        length *= 2
    if found is None:
        return local_rows(docs.sparkSession, [], "id long, length long")
    return found.groupBy("id").agg(F.max("length").alias("length"))


def _cut(window: int, id_field: str, text_field: str, schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            texts = row.field(text_field)
            n_words, n_removed, kept, cleaned = [], [], [], []
            for text, raw in zip(texts.cast(pa.large_binary()).to_pylist(), batch.column("starts").to_pylist()):
                words = (text or b"").split()
                n = len(words)
                n_words.append(n)
                starts = decode_starts(raw) if raw else np.zeros(0, np.int64)
                starts = starts[starts < n]
                if not len(starts):
                    n_removed.append(0)
                    kept.append(b" ".join(words))
                    cleaned.append(text)
                    continue
                edge = np.zeros(n + 1, dtype=np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, np.minimum(starts + window, n), -1)
                gone = np.cumsum(edge[:n]) > 0
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone) if not g]))
                data = np.frombuffer(text, dtype=np.uint8)
                start, _, _ = T.word_bounds(data, np.array([0, len(data)], dtype=np.int64))
                stop = np.append(start[1:], len(data))  # with the white space after a word
                lost = np.flatnonzero(gone)
                drop = np.zeros(len(data) + 1, dtype=np.int64)
                np.add.at(drop, start[lost], 1)
                np.add.at(drop, stop[lost], -1)
                cleaned.append(data[np.cumsum(drop[:-1]) == 0].tobytes())
            yield pa.RecordBatch.from_arrays(
                [row, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(cleaned, pa.binary()).cast(pa.string())],
                ["row", "n_words", "n_removed", "kept", "cleaned"],
            )

    return run


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: row (its columns), n_words, n_removed, kept (the words that stay, joined by
    one space) and cleaned (the text without the removed words and the white space after them)."""
    work = Workspace(docs.sparkSession, "substring")
    slim = docs.select(id_of(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    later = removal_starts(slim, work, window)
    whole = docs.select(id_of(id_col).alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = whole.join(later, "id", "left").select("row", "starts")
    kind = joined.schema["row"].dataType.simpleString()
    return joined.mapInArrow(_cut(window, id_col, text_col, None), f"row {kind}, n_words long, n_removed long, kept string, cleaned string")
