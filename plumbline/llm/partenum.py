"""Jaccard join on word shingles with PartEnum signatures.

Sets are put into bands by size, so that a pair that links lies in one band or in two that follow
each other. For the sets of a band instance a link means a Hamming distance of at most k; the
domain of shingle hashes is cut into n1 parts of three sub-parts each, with n1 chosen so that a
linked pair has a part with at most one difference, and each choice of two sub-parts out of three is
a signature. Linked sets therefore share a signature, whatever they contain; equal sets share a
signature of the whole set, of 128 bits. Candidates are checked against the exact sets. A signature
without a shingle would bring together sets that have nothing in common; so there are some parts more than
needed, and a set with no more parts of that kind leaves such signatures out without losing a link.

Sets that share a signature aren't paired with each other. First each set is checked against one other, the least
member that most of its groups name: that joins nearly all that links, with one pair for each set however large
its family is. Only groups in which labels still differ go on. There each set has a sketch, the parities of its
shingles in cells of their hash; the cells in which two sketches differ are at most the sets' distance, so sizes
and sketches prove of nearly all members of a group that they can't link. What may link in a group is written as
a forest between labels, fewer pairs than members, and the pairs of the forests are checked by the exact sets.
Where all of them link, the components are complete. Families in which some pair doesn't link (sets just below
the threshold) are compared by their exact sets as far as labels differ. Groups and families are worked on in
blocks of bounded size; only what stays outside the largest label of a group visits its other blocks.

Defined cases: null or blank texts have an empty set, link with nothing and are a component of
their own. With fewer words than a shingle the whole sequence is the one shingle. A null id counts as
the smallest id. Rows that share an id are one node: the row whose set comes first (by its 128-bit hash)
stands for it. keep_one takes rows of one id with different texts for different nodes. Texts of any length are
read whole; other columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import exchange as X
from plumbline.llm import textscan as T
from plumbline.llm.components import connected_components
from plumbline.llm.substring import NO_ID, _batch, id_of, text_size
from plumbline.llm.workspace import Workspace, files_of, local_rows

U = np.uint64
BLOCK_SIGNATURES = 400_000
#: Members of a block of a group, and shingles of a block of a family.
BLOCK_MEMBERS, BLOCK_SHINGLES, OVERLAP_COLUMNS = 512, 1 << 18, 512
#: Cells of a sketch: about two for each shingle, between these powers of two.
LEAST_BITS, MOST_BITS = 8, 13
#: Bytes of sketches compared at a time, and the size from which a group is compared row by row.
CHUNK_BYTES, SMALL_GROUP = 4 << 20, 16
#: Size of sets from which signatures without a shingle can be left out.
POOR_FROM = 40
#: Ids that may be broadcast, 8 bytes each, and 8-byte words of sketches or sets that a task takes at a time.
BROADCAST_IDS, BUCKET_WORDS = 500_000, 250_000
PACKED = "slot int, n long, h binary, d binary, w binary, k long, ka binary, kb binary"
_PACKED = (["slot", "n", "h", "d", "w", "k", "ka", "kb"], [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()])
GROUPS = "kind int, a long, b long"


def bands(size: int, percent: int) -> list[tuple[int, int]]:
    """(low, high) of the size bands up to the one that holds size."""
    out, low = [], 1
    while not out or out[-1][1] < size:
        high = low * 100 // percent
        out.append((low, high))
        low = high + 1
    return out


class Plan:
    """Bands and numbers of parts for one similarity; grows with the sizes that it meets."""

    def __init__(self, percent: int):
        self.percent, self.edges = percent, bands(1, percent)
        self.made: dict[int, tuple[int, int, int]] = {}

    def instances(self, size: int) -> list[tuple[int, int, int]]:
        """(instance, n1, slack) that a set of this size takes part in: a linked pair of the instance has more
        than slack parts with at most one difference."""
        if self.edges[-1][1] < size * 2 + 2:
            self.edges = bands(size * 4 + 4, self.percent)
        band = int(np.searchsorted([h for _, h in self.edges], size))
        return [x for i in (band, band + 1) if (x := self.instance(i))[1]]

    def instance(self, i: int) -> tuple[int, int, int]:
        if i not in self.made:
            low, high = self.edges[max(0, i - 1)][0], self.edges[i][1]
            k = (100 - self.percent) * 2 * high // (100 + self.percent)
            n1, slack = (k // 2 + 1 if k else 0), 0
            for _ in range(4 if n1 and low >= POOR_FROM else 0):  # parts that are expected to have a poor signature
                poor = 3 * np.exp(-(low * high) ** 0.5 * 2 / 3 / (n1 + slack)) * (n1 + slack)
                slack = int(poor + 2 * poor**0.5)
            self.made[i] = (i, n1 + slack, slack)
        return self.made[i]


def shingle_sets(data: np.ndarray, offs: np.ndarray, rows: int, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a slice, A-Z lower-cased."""
    data = T.LOWER[data]
    start, end, doc = T.word_bounds(data, offs)
    words = T.span_hashes(data, start, end)
    at, h = T.window_hashes(words, doc, width)
    head = T.doc_starts(doc, rows)
    cut = np.searchsorted(at, head)
    sets = []
    for i in range(rows):
        n = head[i + 1] - head[i]
        if n >= width:
            sets.append(np.unique(h[cut[i] : cut[i + 1]]))
        elif n:
            w = words[head[i] : head[i + 1]]
            sets.append(T.mix(np.array([int(sum(int(x) * (2 * k + 3) for k, x in enumerate(w)) + int(n)) % (1 << 64)], dtype=U)))
        else:
            sets.append(np.zeros(0, U))
    return sets


def signatures(s: np.ndarray, plan: Plan) -> tuple[tuple[int, int], np.ndarray]:
    """The two whole-set signatures and the PartEnum signatures of a non-empty set."""
    value = T.mix(s ^ U(0x5851F42D4C957F2D))
    total = np.zeros(len(s) + 1, dtype=U)
    np.cumsum(value, out=total[1:])
    whole = T.mix(np.array([total[-1] + U(len(s)), T.mix(s ^ U(0x2545F4914F6CDD1D)).sum(dtype=U)], dtype=U))
    out = []
    for instance, n1, slack in plan.instances(len(s)):
        parts = 3 * n1
        bounds = np.arange(1, parts, dtype=U) * U((1 << 64) // parts)
        cut = np.concatenate(([0], np.searchsorted(s, bounds), [len(s)]))
        sums = T.mix((total[cut[1:]] - total[cut[:-1]]) + np.arange(parts, dtype=U)).reshape(n1, 3)
        tag = U((instance * 0x9E3779B97F4A7C15 + 0x1234567) % (1 << 64))
        count = np.diff(cut).reshape(n1, 3)
        poor = count.sum(axis=1)[:, None] == count
        drop = poor.any(axis=1).sum() <= slack
        for skip in range(3):
            a, b = (x for x in range(3) if x != skip)
            found = T.mix(sums[:, a] * U(3) + sums[:, b] * U(5) + tag + U(skip))
            out.append(found[~poor[:, skip]] if drop else found)
    return (int(whole[0]), int(whole[1])), np.concatenate(out) if out else np.zeros(0, U)


def _emit(width: int, percent: int, slots: np.ndarray):
    """(id, text) to packed (signature, id), and for whole sets their second hash; equal sets of a block send
    one id, and the links of the others to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        plan, turn = Plan(percent), TaskContext.get().partitionId() * 7919
        seen: dict[tuple[int, int], int] = {}
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        known: list[tuple[int, int]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            h, d = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            fresh = np.ones(len(h), dtype=bool)
            fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            rows = [(*x, b"", 0, b"", b"") for x in X.pack_sorted(h[fresh], d[fresh], [], slots)]
            one, two = (np.array(x, dtype=U) for x in zip(*seen))
            ids = np.array(list(seen.values()), dtype=np.int64)
            order = np.argsort(one, kind="stable")
            rows += [(*x, 0, b"", b"") for x in X.pack_sorted(one[order], ids[order], [two[order]], slots)]
            if known:
                a, b = (np.array(x, dtype=np.int64) for x in zip(*known))
                rows.append((int(slots[turn % len(slots)]), 0, b"", b"", b"", len(a), X.framed(a), X.framed(b)))
            return _batch(rows, *_PACKED)

        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for i, j, data, offs in T.slices(batch.column("text")):
                for doc, s in zip(ids[i:j], shingle_sets(data, offs, j - i, width)):
                    if not len(s):
                        continue
                    whole, more = signatures(s, plan)
                    rep = seen.setdefault(whole, int(doc))
                    if rep != doc:
                        known.append((int(doc), rep))
                        continue
                    parts.append((more, np.full(len(more), doc, dtype=np.int64)))
                    held += len(more) + 1
                if held >= BLOCK_SIGNATURES or len(known) >= BLOCK_SIGNATURES:
                    yield flush()
                    parts, known, seen, held, turn = [], [], {}, 0, turn + 1
                    T.tidy()
        if seen:
            yield flush()
        T.tidy()

    return run


def _group(table: pa.Table) -> pa.Table:
    """Links of equal sets (kind 0), and members (kind 1: group as a, id as b) of the groups of sets that
    share a signature."""
    h, d, eh, ed, ew, ka, kb = [], [], [], [], [], [], []
    for r in table.to_pylist():
        if r["k"]:
            ka.append(X.unframed(r["ka"], r["k"])), kb.append(X.unframed(r["kb"], r["k"]))
        elif r["w"]:
            x, y, z = X.unpack(r["n"], r["h"], r["d"], [r["w"]])
            eh.append(x), ed.append(y), ew.append(z)
        else:
            x, y = X.unpack(r["n"], r["h"], r["d"], [])
            h.append(x), d.append(y)
    kind, a, b = [np.zeros(sum(map(len, ka)), np.int32)], list(ka), list(kb)
    if eh:
        x, y, z = np.concatenate(eh), np.concatenate(ed), np.concatenate(ew)
        order = np.lexsort((y, z, x))
        x, y, z = x[order], y[order], z[order]
        new = np.append(True, (x[1:] != x[:-1]) | (z[1:] != z[:-1]))
        least = y[new][np.cumsum(new) - 1]
        other = y != least
        kind.append(np.zeros(int(other.sum()), np.int32)), a.append(y[other]), b.append(least[other])
    if h:
        h, d = np.concatenate(h), np.concatenate(d)
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        new = np.append(True, h[1:] != h[:-1])
        keep = new | np.append(True, d[1:] != d[:-1])
        h, d, new = h[keep], d[keep], new[keep]
        group = np.cumsum(new) - 1
        near = np.bincount(group)[group] > 1
        # A group is named by its members, so that signatures with the same members are one group.
        name = np.zeros(int(new.sum()), dtype=U)
        np.add.at(name, group[near], T.mix(d[near].view(U) + U(0x632BE59BD9B4E019)))
        pairs = np.unique(np.stack((T.mix(name)[group[near]].view(np.int64), d[near])), axis=1) if near.any() else np.zeros((2, 0), np.int64)
        kind.append(np.ones(pairs.shape[1], np.int32)), a.append(pairs[0]), b.append(pairs[1])
    T.tidy()
    kind, a, b = np.concatenate(kind), np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])
    return pa.table({"kind": pa.array(kind, pa.int32()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def sketch(s: np.ndarray) -> bytes:
    """Parities of the numbers of shingles in cells; twice as many cells fold to these by exclusive or."""
    bits = 1 << min(max((2 * len(s)).bit_length(), LEAST_BITS), MOST_BITS)
    odd = np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(raw: list[bytes], size: int) -> np.ndarray:
    """Sketches at a common size in bytes, one a row, as 64-bit words."""
    out = np.zeros((len(raw), size), np.uint8)
    for k, r in enumerate(raw):
        x = np.frombuffer(r, np.uint8)
        out[k] = x if len(x) == size else np.bitwise_xor.reduce(x.reshape(-1, size), axis=0)
    return out.view(U)


def _sketches(width: int):
    """(id, text) to (id, n, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for i, j, data, offs in T.slices(batch.column("text")):
                sets = shingle_sets(data, offs, j - i, width)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary())], ["id", "n", "sketch"])
        T.tidy()

    return run


def _sets(width: int):
    """(id, text) to (id, n, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for i, j, data, offs in T.slices(batch.column("text")):
                sets = shingle_sets(data, offs, j - i, width)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "n", "shingles"])
        T.tidy()

    return run


def alike(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    both = len(s) + len(t) - len(np.union1d(s, t))
    return both > 0 and 100 * both >= percent * (len(s) + len(t) - both)


def may_link(apart: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and the distance of sketches leave a link possible."""
    return ((100 + percent) * apart <= (100 - percent) * (n + m)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))


def forest(near: np.ndarray, own: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Edges (member, nearer to the hub) of a spanning forest of a graph between the members `own` and all: near has
    a row for each of own and a column for each member. Members of one label are joined from the start. Each tree
    starts at its first member, so that the groups of a family give the same pairs."""
    place = np.full(near.shape[1], -1)
    place[own] = np.arange(len(own))
    found, free = [], near.any(axis=0)
    free[own] |= near.any(axis=1)
    where: dict[int, list[int]] = {}
    for k in np.flatnonzero(free):
        where.setdefault(int(label[k]), []).append(int(k))
    for hub in np.flatnonzero(free):
        if not free[hub]:
            continue
        queue = where.pop(int(label[hub]))
        free[queue] = False
        queue = [int(hub), *(k for k in queue if k != hub)]
        for x in queue:
            if not free.any():
                break
            around = np.flatnonzero(near[place[x]] & free) if place[x] >= 0 else own[near[:, x] & free[own]]
            for y in around:
                if free[y]:
                    found.append((int(y), x))
                    same = where.pop(int(label[y]))
                    free[same] = False
                    queue += same
    return found


def _forests(percent: int):
    """Rows (unit, block, id, label, visiting, n, sketch) of several blocks to the pairs (a, b) of forests of
    what may link: fewer than rows. Visiting rows aren't compared with each other."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("unit", "ascending"), ("block", "ascending"), ("id", "ascending")])
        unit, block, ids, label, n = (table.column(c).to_numpy() for c in ("unit", "block", "id", "label", "n"))
        visiting = np.array(table.column("visiting").to_pylist(), dtype=bool)
        raw = table.column("sketch").to_pylist()
        cut = np.append(np.flatnonzero(np.append(True, (unit[1:] != unit[:-1]) | (block[1:] != block[:-1]))), len(ids))
        out: set[tuple[int, int]] = set()
        least = np.minimum.reduceat(np.array([len(r) for r in raw]), cut[:-1])
        members = np.diff(cut)
        small: dict[int, list[int]] = {}
        for g in np.flatnonzero((members > 1) & (members <= SMALL_GROUP)):
            small.setdefault(int(least[g]), []).append(int(g))
        for size, groups in small.items():  # all pairs of many small groups at a time
            at = 0
            while at < len(groups):
                x, y, some = [], [], 0
                while at < len(groups) and some * size < CHUNK_BYTES:
                    i, m = cut[groups[at]], members[groups[at]]
                    p, q = np.triu_indices(m, 1)
                    x.append(i + p), y.append(i + q)
                    some, at = some + len(p), at + 1
                x, y = np.concatenate(x), np.concatenate(y)
                rows, where = np.unique(np.concatenate((x, y)), return_inverse=True)
                bits = folded([raw[k] for k in rows], size)
                apart = np.bitwise_count(bits[where[: len(x)]] ^ bits[where[len(x) :]]).sum(axis=1, dtype=np.int64)
                good = may_link(apart, n[x], n[y], percent) & (label[x] != label[y]) & ~(visiting[x] & visiting[y])
                root: dict[tuple[int, int], tuple[int, int]] = {}

                def find(k):
                    while root.get(k, k) != k:
                        k = root[k]
                    return k

                group = np.searchsorted(cut, x[good], side="right")
                for g, p, q in zip(group.tolist(), x[good].tolist(), y[good].tolist()):
                    a, b = find((g, int(label[p]))), find((g, int(label[q])))
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        out.add((int(ids[q]), int(ids[p])))
        for g in np.flatnonzero(members > SMALL_GROUP):
            i, j = int(cut[g]), int(cut[g + 1])
            bits, m = folded(raw[i:j], int(least[g])), j - i
            own = np.flatnonzero(~visiting[i:j])
            near = np.zeros((len(own), m), dtype=bool)
            step = max(1, CHUNK_BYTES // (m * int(least[g])))
            for x in range(0, len(own), step):
                rows = own[x : x + step]
                apart = np.bitwise_count(bits[rows, None, :] ^ bits[None, :, :]).sum(axis=2, dtype=np.int64)
                near[x : x + step] = may_link(apart, n[i:j][rows, None], n[None, i:j], percent) & (label[i:j][rows, None] != label[None, i:j])
            out.update((int(ids[i + p]), int(ids[i + q])) for p, q in forest(near, own, label[i:j]))
        a, b = zip(*sorted(out)) if out else ((), ())
        T.tidy()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _linked(percent: int):
    """(a, b, sa, sb) to (a, b, link): the exact check of a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = [alike(np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U), percent) for x, y in zip(batch.column("sa"), batch.column("sb"))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(links, pa.bool_())], ["a", "b", "link"])
        T.tidy()

    return run


def overlaps(sets: list[np.ndarray], own: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets listed in own with all sets: products of 0-1 matrices over
    the values that several sets have, OVERLAP_COLUMNS values at a time."""
    n = len(sets)
    out = np.zeros((len(own), n), np.float32)
    value, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = count > 1
    kept = shared[column]
    row, column = row[kept], (np.cumsum(shared) - 1)[column[kept]]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    for c in range(0, int(shared.sum()), OVERLAP_COLUMNS):
        i, j = np.searchsorted(column, [c, c + OVERLAP_COLUMNS])
        part = np.zeros((n, OVERLAP_COLUMNS), np.float32)
        part[row[i:j], column[i:j] - c] = 1
        out += part[own] @ part.T
    return out


def _exact(percent: int):
    """Rows (unit, block, id, label, visiting, n, shingles) of several blocks to links that join labels: fewer
    than labels. Sets of a block are intersected with each other and with visiting ones."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("unit", "ascending"), ("block", "ascending"), ("id", "ascending")])
        unit, block, ids, label = (table.column(c).to_numpy() for c in ("unit", "block", "id", "label"))
        visiting = np.array(table.column("visiting").to_pylist(), dtype=bool)
        raw = table.column("shingles")
        cut = np.append(np.flatnonzero(np.append(True, (unit[1:] != unit[:-1]) | (block[1:] != block[:-1]))), len(ids))
        out: set[tuple[int, int]] = set()
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
            own = np.flatnonzero(~visiting[i:j])
            if j - i < 2 or not len(own):
                continue
            sets = [np.frombuffer(x.as_py(), U) for x in raw.slice(i, j - i)]
            n = np.array([len(s) for s in sets], dtype=np.float32)
            both = overlaps(sets, own)
            near = np.empty(both.shape, dtype=bool)
            for x, k in enumerate(own):
                near[x] = (both[x] > 0) & (100 * both[x] >= percent * (n[k] + n - both[x])) & (label[i:j] != label[i + k])
            out.update((int(ids[i + p]), int(ids[i + q])) for p, q in forest(near, own, label[i:j]))
        a, b = zip(*sorted(out)) if out else ((), ())
        T.tidy()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


LINKS, SKETCHES = "a long, b long", "id long, n long, sketch binary"


def chosen(table: DataFrame, ids: DataFrame, at_most: int) -> DataFrame:
    """The rows of table whose id is in ids, of which there are so many at most; few are broadcast."""
    ids = ids.select("id").distinct()
    return table.join(F.broadcast(ids) if at_most <= BROADCAST_IDS else ids, "id", "left_semi")


def sketched(docs: DataFrame, ids: DataFrame, count: int, width: int) -> DataFrame:
    """(id, n, sketch) of the documents in ids, of which there are so many. Too many to broadcast, they are joined with the
    sketches of all documents: no text goes through an exchange, however many there are."""
    if count <= BROADCAST_IDS:
        return chosen(docs, ids, count).mapInArrow(_sketches(width), SKETCHES)
    return chosen(docs.mapInArrow(_sketches(width), SKETCHES), ids, count)


def labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    """rows with their label: the component, or the id where nothing links."""
    return rows.join(label, "id", "left").select(*rows.columns, F.coalesce("component", "id").alias("label"))


def hubs(members: DataFrame) -> DataFrame:
    """(a, b): for each member (unit, id) that isn't the least of all its groups, the one that is the least of most."""
    least = members.groupBy("unit").agg(F.min("id").alias("least"))
    shared = members.join(least, "unit").where("id != least").groupBy("id", "least").agg(F.count("*").alias("n"))
    best = shared.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "least")).alias("best"))
    return best.select(F.col("id").alias("a"), F.col("best.least").alias("b"))


class Sweep:
    """Compares the members of units in blocks until every two of them that don't have one label have met."""

    def __init__(self, work: Workspace, name: str, payload: DataFrame, compare, per_row: int, settle: Callable[[DataFrame, str], DataFrame], files: int):
        self.work, self.name, self.payload, self.compare, self.settle = work, name, payload, compare, settle
        self.per_row, self.files = per_row, files

    def meet(self, rows: DataFrame, step: str) -> DataFrame:
        """rows (unit, block, id, label, visiting) to links, by compare and settle."""
        name = f"{self.name}-{step}"
        rows = self.work.save(rows, f"{name}-rows", small=True, files=self.files)
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(4 * parts, rows.count() * self.per_row // BUCKET_WORDS)
        # By blocks, not by families: a bucket's size doesn't follow that of a family.
        slot = F.pmod(F.xxhash64("unit", "block"), F.lit(buckets)).cast("int").alias("slot")
        placed = rows.select(slot, *rows.columns)
        whole = placed.join(self.payload, "id").select("slot", "unit", "block", "id", "label", "visiting", *[c for c in self.payload.columns if c != "id"])
        return self.settle(self.work.save(lambda: whole.groupBy("slot").applyInArrow(self.compare, LINKS).distinct(), name, files=self.files), name)

    def run(self, rows: DataFrame, links: DataFrame) -> DataFrame:
        """rows (unit, id, label, blocks); links (a, b) that hold already, by which sets have one label. All links
        found: with those given they join all that links join in any unit."""
        work, name = self.work, self.name
        rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        found = self.meet(rows.select("unit", "block", "id", "label", F.lit(False).alias("visiting")), "inside")
        wide = rows.where("blocks > 1")
        if wide.isEmpty():
            return found
        for step in ("heads", "last"):
            label = connected_components(links.unionByName(found), work, f"{name}-{step}")
            named = labelled(wide.drop("label"), label)
            tally = named.groupBy("unit", "label").agg(F.count("*").alias("n")).groupBy("unit").agg(F.count("*").alias("labels"), F.max(F.struct("n", "label")).alias("top")).where("labels > 1")
            named = work.save(named.join(tally.select("unit", F.col("top.label").alias("top")), "unit"), f"{name}-{step}-named", files=self.files)
            if named.isEmpty():
                return found
            if step == "heads":  # one member of each label of a block
                heads = named.groupBy("unit", "block", "label").agg(F.min("id").alias("id"))
                room = heads.groupBy("unit").agg(F.ceil(F.count("*") / BLOCK_MEMBERS).cast("int").alias("rooms"))
                rows = heads.join(room, "unit").select("unit", F.pmod(F.xxhash64("id"), F.col("rooms")).cast("int").alias("block"), "id", "label", F.lit(False).alias("visiting"))
            else:  # stragglers visit all blocks, so many at a time: a block then stands once for each load of visitors
                loads = named.groupBy("unit").agg(F.ceil(F.sum((F.col("label") != F.col("top")).cast("int")) / BLOCK_MEMBERS).cast("int").alias("loads"))
                named = named.join(loads, "unit")
                block = lambda load: (F.col("block") * F.col("loads") + load).alias("block")
                stay = named.select("unit", "id", "label", F.lit(False).alias("visiting"), "block", "loads", F.explode(F.sequence(F.lit(0), F.col("loads") - 1)).alias("load"))
                trip = named.where("label != top").select("unit", "id", "label", F.lit(True).alias("visiting"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "loads", F.pmod(F.xxhash64("id"), F.col("loads")).cast("int").alias("load"), F.col("block").alias("own"))
                rows = stay.unionByName(trip.where("block != own").drop("own")).select("unit", block(F.col("load")), "id", "label", "visiting")
            found = found.unionByName(self.meet(rows, step))
        return found


def components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component) of every document that links with another: the smallest id that it reaches
    by links of at least `percent` Jaccard similarity of `width`-word shingles."""
    spark = docs.sparkSession
    work = Workspace(spark, "partenum")
    docs = docs.select(id_of(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if not docs.groupBy("id").count().where("count > 1").isEmpty():
        docs = docs.groupBy("id").agg(F.min("text").alias("text"))
    size = text_size(docs)
    items, files = size // 6 * 3 * (100 - percent) // (100 + percent) * 2 + 1, files_of(text=size)
    slots = X.even_slots(spark, items)
    groups = work.save(lambda: docs.mapInArrow(_emit(width, percent, slots), PACKED).groupBy("slot").applyInArrow(_group, GROUPS), "groups", files=files)
    equal = groups.where("kind = 0").select("a", "b")
    # Of equal sets the least id stands in groups.
    members = work.save(lambda: groups.where("kind = 1").select(F.col("a").alias("unit"), F.col("b").alias("id")).distinct().join(equal.select(F.col("a").alias("id")).distinct(), "id", "left_anti"), "members", files=files)

    def checked(pairs: DataFrame, name: str) -> DataFrame:
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
        count = pairs.count()
        sets = work.save(lambda: chosen(docs, ids, 2 * count).mapInArrow(_sets(width), "id long, n long, shingles binary"), f"{name}-sets", files=files)
        one, two = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
        out = work.save(lambda: pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(_linked(percent), f"{LINKS}, link boolean"), f"{name}-checked", files=files)
        work.drop(f"{name}-sets")
        return out

    tried: list[DataFrame] = []

    def settle(pairs: DataFrame, name: str) -> DataFrame:
        tried.append(checked(pairs, name))
        return tried[-1].where("link").select("a", "b")

    links = checked(work.save(lambda: hubs(members), "hubs", files=files), "hubs").where("link").select("a", "b").unionByName(equal)
    label = connected_components(links, work, "hublabels")
    named = labelled(members, label)
    differ = named.groupBy("unit").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.ceil(F.count("*") / BLOCK_MEMBERS).cast("int").alias("blocks")).where("lo != hi")
    rows = work.save(lambda: named.join(differ.select("unit", "blocks"), "unit"), "open", files=files)
    if not rows.isEmpty():
        count = rows.select("id").distinct().count()
        sketches = work.save(lambda: sketched(docs, rows, count, width), "sketches", files=files)
        found = Sweep(work, "near", sketches, _forests(percent), 16, settle, files).run(rows, links)
        if not found.isEmpty():
            links = links.unionByName(found)
            label = connected_components(links, work, "labels")
        if not all(t.where("not link").isEmpty() for t in tried):
            label = exact(docs, tried, links, equal, label, work, width, percent, files)
    return work.only(label, "components")


def exact(docs: DataFrame, tried: list[DataFrame], links: DataFrame, equal: DataFrame, label: DataFrame, work: Workspace, width: int, percent: int, files: int) -> DataFrame:
    """Components of true links, where some pairs that sketches couldn't tell apart are no links: the members
    of their families are compared by their sets as far as they have several labels. A forest takes sets of one
    label for joined, so links hold families together too."""
    pairs = links
    for t in tried:
        pairs = pairs.unionByName(t.select("a", "b"))
    family = labelled(connected_components(pairs, work, "families").withColumnRenamed("component", "unit"), label)
    mixed = family.groupBy("unit").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("unit")
    family = family.join(mixed, "unit", "left_semi").join(equal.select(F.col("a").alias("id")).distinct(), "id", "left_anti")
    family = work.save(family.select("id", "unit", "label"), "mixed", files=files)
    count = family.count()
    sets = work.save(lambda: chosen(docs, family, count).mapInArrow(_sets(width), "id long, n long, shingles binary"), "mixedsets", files=files)
    blocks = family.join(sets.select("id", "n"), "id").groupBy("unit").agg(F.ceil(F.greatest(F.count("*") / BLOCK_MEMBERS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    mean = int(sets.agg(F.avg("n")).first()[0] or 1)
    more = Sweep(work, "exact", sets, _exact(percent), mean, lambda pairs, name: pairs, files).run(family.join(blocks, "unit"), links)
    return label if more.isEmpty() else connected_components(links.unionByName(more), work, "final")


def _sizes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(s) for i, j, data, offs in T.slices(batch.column("text")) for s in shingle_sets(data, offs, j - i, width)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64())], ["id", "n_shingles"])

    return run


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its id, n_shingles and component_id."""
    comps = components(docs, width, percent, id_col, text_col)
    sized = docs.select(id_of(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_sizes(width), "id long, n_shingles long")
    named = sized.join(comps, "id", "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return named.select(real("id").alias(id_col), "n_shingles", real("component_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay when of each component the document with the smallest id does. Rows that
    share an id, null ids too, are documents of their own unless their texts are equal: then one stays. Blank
    texts resemble nothing, so all their rows stay."""
    shared = docs.groupBy(id_of(id_col)).count().where("count > 1")
    if shared.isEmpty():
        gone = components(docs, width, percent, id_col, text_col).where("id != component").select(F.col("id").alias("__gone"))
        return docs.join(gone, id_of(id_col) == F.col("__gone"), "left_anti")
    text = F.col(text_col).cast("string")
    nodes = docs.withColumn("__node", F.xxhash64(id_of(id_col), text))
    named = nodes.select("__node", id_of(id_col).alias("__id")).join(components(nodes, width, percent, "__node", text_col), F.col("__node") == F.col("id"))
    least = named.groupBy("component").agg(F.min(F.struct("__id", "__node"))["__node"].alias("__stays"))
    gone = named.join(least, "component").where("__node != __stays").select(F.col("__node").alias("__gone")).distinct()
    kept = nodes.join(gone, F.col("__node") == F.col("__gone"), "left_anti")
    blank = ~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return kept.where(~blank).dropDuplicates(["__node"]).unionByName(kept.where(blank)).drop("__node")
