"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into cells of CELL words; two neighbouring cells are a passage, one TF-IDF row. The features
are the benchmark's words; other words count towards a passage's length only, as no cosine with a benchmark
passage has a part in them. A randomised SVD finds the latent space of RANK dimensions, fewer than passages in a
full block: every map task adds its part of A'A times a random matrix, parts are summed in the cluster,
and the Nystroem step on the driver turns the sum (features by rank) into singular directions. Benchmark
passages are rows of the same matrix, weighted so that the space holds them next to the corpus.

Every passage of every document is then compared with every benchmark passage by cosine in that space.
A cosine misses short items among other words, and items of frequent words. So a passage is a candidate, too,
when the words around it could hold an item's common subsequence: of the item's words, rarest first, all but
those that may be missing are looked up, and SURE of them must be there. This bound loses nothing.
Candidates are checked on whole word sequences: the longest common subsequence of the item and the
words around the passage, and whether the item's answer (its last sentence) stands there too. A long item is
looked for in passages of its own; its answer may stand as far away as the item is long.

A benchmark is taken in blocks of at most BLOCK_ITEMS passages, SCAN_BLOCKS of them in one scan, so what is
broadcast is bounded; each block is a query set against all documents.

Defined cases: null or empty texts are clean. Items without a word match nothing; those with fewer
than MIN_WORDS words must be there word for word. Null ids of documents and items are an id of their own. Rows that share an
id share the finding. Ties of the best item go to the smaller item id. An empty benchmark or corpus gives
no finding. Texts are read whole; other columns play no part.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import exchange as X
from plumbline.llm import textscan as T
from plumbline.llm.substring import id_of
from plumbline.llm.workspace import Workspace, local_rows

CELL, BLOCK_ITEMS, SCAN_BLOCKS, RANK, MIN_WORDS = 24, 256, 8, 128, 8
COSINE, LCS_ALONE, LCS_WITH_ANSWER, ANSWER = 0.35, 0.7, 0.55, 0.8
STOP_SHARE, STOP_LEAST = 0.005, 50
SURE = 6
SUM_RANGES = 48
SLICE = 256 << 10
U = np.uint64

#: What isn't part of a word: all ASCII but letters and digits.
GAPS = np.zeros(256, dtype=bool)
GAPS[:128] = True
GAPS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def lowered(data: np.ndarray) -> np.ndarray:
    """Letters A to Z and the Latin-1 capitals in lower case, in place of one another's bytes."""
    out = T.LOWER[data]
    if len(out) > 1:
        at = np.flatnonzero(data[:-1] == 0xC3) + 1
        second = data[at]
        out[at[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)]] += 32
    return out


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each word."""
    data = lowered(data)
    start, end, doc = T.word_bounds(data, offs, GAPS)
    return T.span_hashes(data, start, end), doc


def text_words(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return words_of(data, np.array([0, len(data)], dtype=np.int64))[0]


class Vocabulary:
    """Index of the benchmark's words, -1 for others."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.hashes & U(0xFFFF)).astype(np.int64)] = True

    def __call__(self, words: np.ndarray) -> np.ndarray:
        out = np.full(len(words), -1, dtype=np.int64)
        rows = np.flatnonzero(self.maybe[(words & U(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, words[rows]), len(self.hashes) - 1)
        hit = self.hashes[at] == words[rows]
        out[rows[hit]] = at[hit]
        return out


def cells_of(doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each word, numbered through the slice, and the first cell of each document (and end)."""
    head = T.doc_starts(doc, n_docs)
    per = -(-np.diff(head) // CELL)
    first = np.append(0, np.cumsum(per))
    return first[doc] + (np.arange(len(doc)) - head[doc]) // CELL, first


class Rows:
    """The TF-IDF rows of a slice, kept as cells: (cell, feature, value) by cell, where passage p is the
    sum of cell p and the cell after it, divided by the norm of all its words. A last cell has a passage of
    its own only if it is its document's only one."""

    def __init__(self, cell: np.ndarray, feature: np.ndarray, first: np.ndarray, weight: np.ndarray, other: float):
        n = self.n = int(first[-1])
        known = feature >= 0
        outside = np.bincount(cell, minlength=n) - np.bincount(cell[known], minlength=n)
        useful = np.flatnonzero(known)
        useful = useful[weight[feature[useful]] > 0]
        key, tf = np.unique(cell[useful] * len(weight) + feature[useful], return_counts=True)
        self.c, self.f = key // len(weight), key % len(weight)
        self.v = tf * weight[self.f]
        own = np.bincount(self.c, weights=self.v**2, minlength=n)
        at = np.minimum(np.searchsorted(key, key + len(weight)), max(len(key) - 1, 0))
        both = np.flatnonzero(key[at] == key + len(weight)) if len(key) else np.zeros(0, np.int64)
        shared = np.bincount(self.c[both], weights=self.v[both] * self.v[at[both]], minlength=n)
        last = np.zeros(n, dtype=bool)
        last[first[1:][np.diff(first) > 0] - 1] = True
        alone = np.zeros(n, dtype=bool)
        alone[first[:-1][np.diff(first) == 1]] = True
        self.pair, self.there = ~last, ~last | alone
        after = lambda x: np.append(x[1:], 0.0)
        inside = own + np.where(self.pair, after(own) + 2 * shared, 0)
        free = outside * other**2
        whole = inside + free + np.where(self.pair, after(free), 0)
        self.norm = np.sqrt(np.maximum(whole, 1e-12))
        self.share = np.where(self.there, inside / np.maximum(whole, 1e-12), 0)
        self.v = self.v.astype(np.float32)

    def times(self, matrix: np.ndarray, some: np.ndarray | None = None) -> np.ndarray:
        """Passages (those marked in some, or all) by columns of the matrix."""
        c, f, v = self.c, self.f, self.v
        if some is not None:
            need = some.copy()
            need[1:] |= some[:-1] & self.pair[:-1]
            keep = need[c]
            c, f, v = c[keep], f[keep], v[keep]
        cells = np.zeros((self.n + 1, matrix.shape[1]), np.float32)
        if len(c):
            cut = np.flatnonzero(np.diff(c, prepend=-1))
            cells[c[cut]] = np.add.reduceat(v[:, None] * matrix[f], cut, axis=0)
        out = cells[:-1] + np.where(self.pair[:, None], cells[1:], 0)
        return out * np.where(self.there, 1 / self.norm, 0).astype(np.float32)[:, None]

    def add_transposed(self, total: np.ndarray, y: np.ndarray) -> None:
        """Adds the passages' transpose times y to total."""
        if not len(self.c):
            return
        y = y * np.where(self.there, 1 / self.norm, 0).astype(np.float32)[:, None]
        back = y.copy()
        back[1:] += np.where(self.pair[:-1, None], y[:-1], 0)
        by = np.argsort(self.f, kind="stable")
        f = self.f[by]
        cut = np.flatnonzero(np.diff(f, prepend=-1))
        total[f[cut]] += np.add.reduceat(self.v[by][:, None] * back[self.c[by]], cut, axis=0)


def _frequencies(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(vocabulary)
        total, n = np.zeros(len(known.hashes), dtype=np.int64), 0
        for batch in batches:
            for i, j, data, offs in T.slices(batch.column("text"), SLICE):
                words, doc = words_of(data, offs)
                cell, first = cells_of(doc, j - i)
                feature = known(words)
                hit = feature >= 0
                pairs = np.unique(cell[hit] * len(total) + feature[hit])
                total += np.bincount(pairs % len(total), minlength=len(total))
                n += int(first[-1])
        from pyspark import TaskContext

        slot = TaskContext.get().partitionId() % SUM_RANGES
        yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([n], pa.int64()), pa.array([X.planes(total.astype(U))], pa.binary())], ["slot", "n", "df"])

    return run


def _sum_frequencies(size: int):
    def run(table: pa.Table) -> pa.Table:
        total = sum(X.unplanes(raw, size) for raw in table.column("df").to_pylist())
        return pa.table({"n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "df": pa.array([X.planes(total)], pa.binary())})

    return run


def _project(blocks: list[Block], slots: np.ndarray):
    """Texts to parts (b, r, z) of A'A times the random matrix: of block b the features of range r."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Vocabulary(b.vocabulary.hashes) for b in blocks]
        omega = [random_matrix(len(b.weight), b.rank) for b in blocks]
        totals = [np.zeros_like(o) for o in omega]
        for batch in batches:
            for i, j, data, offs in T.slices(batch.column("text"), SLICE):
                words, doc = words_of(data, offs)
                cell, first = cells_of(doc, j - i)
                for b, block in enumerate(blocks):
                    rows = Rows(cell, known[b](words), first, block.weight, block.other)
                    rows.add_transposed(totals[b], rows.times(omega[b]))
        for b, total in enumerate(totals):
            cut = len(total) * np.arange(SUM_RANGES + 1) // SUM_RANGES
            some = [r for r in range(SUM_RANGES) if total[cut[r] : cut[r + 1]].any()]
            yield pa.RecordBatch.from_arrays([pa.array([int(slots[(r + b) % len(slots)]) for r in some], pa.int32()), pa.array([b] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array([total[cut[r] : cut[r + 1]].tobytes() for r in some], pa.binary())], ["slot", "b", "r", "z"])

    return run


def random_matrix(rows: int, rank: int) -> np.ndarray:
    return np.random.default_rng(20_11).standard_normal((rows, rank)).astype(np.float32)


def _sum_parts(table: pa.Table) -> pa.Table:
    total = None
    for raw in table.column("z").to_pylist():
        part = np.frombuffer(raw, dtype=np.float32)
        total = part.astype(np.float64) if total is None else total + part
    return pa.table({"b": table.column("b").slice(0, 1).cast(pa.int32()), "r": table.column("r").slice(0, 1).cast(pa.int32()), "z": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


class Block:
    """Some benchmark passages and their latent space."""

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray, int]]):
        self.items = items  # (item id, word hashes, hashes of the answer's words, words of the whole item)
        self.vocabulary = Vocabulary(np.concatenate([w for _, w, *_ in items]))
        self.rank = min(len(self.vocabulary.hashes), RANK)

    def rows(self):
        """TF-IDF rows of the passages themselves."""
        words = np.concatenate([w for _, w, *_ in self.items])
        owner = np.repeat(np.arange(len(self.items)), [len(w) for _, w, *_ in self.items])
        key, tf = np.unique(owner * len(self.weight) + self.vocabulary(words), return_counts=True)
        p, f = key // len(self.weight), key % len(self.weight)
        v = tf * self.weight[f]
        norm = np.sqrt(np.bincount(p, weights=v**2, minlength=len(self.items)))
        return p, f, (v / np.maximum(norm[p], 1e-9)).astype(np.float32)

    def weigh(self, df: np.ndarray, n: int) -> None:
        """Inverse cell frequencies; frequent words get none, unless an item has nothing else."""
        idf = np.log((n + 1) / (df + 1)) + 1e-3
        weight = np.where(df > max(STOP_LEAST, STOP_SHARE * n), 0.0, idf)
        for _, w, *_ in self.items:
            f = self.vocabulary(w)
            if not weight[f].any():
                weight[f] = idf[f]
        self.weight = weight
        self.post(df)
        self.other = float(np.median(weight[weight > 0]))

    def post(self, df: np.ndarray) -> None:
        """Postings of each item's rarest words: a passage with `least` words of the item in order has `sure` of
        the len(w) - least + sure rarest around it, wherever the others are."""
        feature, item, self.sure = [], [], np.zeros(len(self.items), dtype=np.int64)
        for k, (_, w, *_) in enumerate(self.items):
            least = math.ceil(LCS_WITH_ANSWER * len(w) - 1e-9) if len(w) >= MIN_WORDS else len(w)
            self.sure[k] = min(SURE, least)
            f = self.vocabulary(w)
            rare = f[np.argsort(df[f], kind="stable")][: len(w) - least + self.sure[k]]
            some, n = np.unique(rare, return_counts=True)
            feature.append(np.repeat(some, n))
            item.append(np.full(len(rare), k))
        feature, item = np.concatenate(feature), np.concatenate(item)
        self.time_of, self.times = np.unique(item * len(self.vocabulary.hashes) + feature, return_counts=True)
        by = np.argsort(feature, kind="stable")
        self.posted = item[by]
        self.post_at = np.append(0, np.cumsum(np.bincount(feature, minlength=len(self.vocabulary.hashes))))
        self.length = np.array([len(w) for _, w, *_ in self.items])

    def possible(self, feature: np.ndarray, cell: np.ndarray, first: np.ndarray, there: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Keys passage * items + item of all passages of a slice that could hold an item."""
        many = np.where(feature >= 0, np.diff(self.post_at)[feature], 0)
        at = np.flatnonzero(many)
        n = many[at]
        item = self.posted[np.repeat(self.post_at[feature[at]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        at = np.repeat(at, n)
        # Only words that have enough others of the item within reach of one passage.
        order = np.argsort(item * len(feature) + at, kind="stable")
        item, at = item[order], at[order]
        keep = np.zeros(len(at) + 1, dtype=np.int64)
        for sure in range(1, SURE + 1):
            i = np.flatnonzero(self.sure[item[: max(0, len(item) - sure + 1)]] == sure)
            i = i[(item[i + sure - 1] == item[i]) & (at[i + sure - 1] - at[i] < 2 * CELL + 2 * self.length[item[i]])]
            np.add.at(keep, i, 1)
            np.add.at(keep, i + sure, -1)
        kept = np.cumsum(keep[:-1]) > 0
        item, at = item[kept], at[kept]
        d = np.searchsorted(first, cell[at], side="right") - 1
        place = at - head[d]
        # Passages that have the word in reach: from CELL * p - length to CELL * (p + 2) + length.
        low = np.maximum(0, (place - self.length[item]) // CELL - 1)
        high = np.minimum(first[d + 1] - first[d] - 1, (place + self.length[item]) // CELL)
        keys, size = [np.zeros(0, np.int64)], len(self.vocabulary.hashes)
        for step in range(int((high - low).max(initial=-1)) + 1):
            on = low + step <= high
            passage = first[d[on]] + low[on] + step
            keys.append((passage * len(self.items) + item[on]) * size + feature[at[on]])
        # A word counts once for each time that the item's rarest words have it.
        each = np.unique(np.concatenate(keys))
        key, inverse = np.unique(each // size, return_inverse=True)
        times = self.times[np.searchsorted(self.time_of, key[inverse] % len(self.items) * size + each % size)]
        key = key[np.bincount(inverse, weights=times, minlength=len(key)) >= self.sure[key % len(self.items)]]
        return key[there[key // len(self.items)]]

    def embed(self, gathered: np.ndarray, n: int) -> None:
        """Nystroem: directions of A'A from A'A omega."""
        rank = gathered.shape[1]
        omega = random_matrix(len(self.weight), rank)
        total = gathered.astype(np.float64)
        p, f, v = self.rows()
        y = np.zeros((len(self.items), rank), np.float32)
        np.add.at(y, p, v[:, None] * omega[f])
        own = np.zeros_like(gathered)
        np.add.at(own, f, v[:, None] * y[p])
        total += own * max(1.0, n / len(self.items))
        q, r = np.linalg.qr(total)
        core = omega.T.astype(np.float64) @ total
        values, u = np.linalg.eigh(r @ np.linalg.pinv((core + core.T) / 2, rcond=1e-9, hermitian=True) @ r.T)
        good = values > max(values.max(), 0) * 1e-10
        self.space = (q @ u[:, good]).astype(np.float32)
        placed = np.zeros((len(self.items), self.space.shape[1]), np.float32)
        np.add.at(placed, p, v[:, None] * self.space[f])
        self.placed = placed / np.maximum(np.linalg.norm(placed, axis=1, keepdims=True), 1e-9)


def lcs(masks: dict[int, int], length: int, words: list[int]) -> int:
    """Length of the longest common subsequence, a machine word of the item at a time."""
    full = (1 << length) - 1
    s = full
    for w in words:
        m = masks.get(w)
        if m:
            u = s & m
            s = ((s + u) | (s - u)) & full
    return length - s.bit_count()


def _masks(block: Block) -> list[dict[int, int]]:
    """Of each item, the places of its words as bits."""
    masks = []
    for _, w, *_ in block.items:
        m: dict[int, int] = {}
        for k, x in enumerate(w.tolist()):
            m[x] = m.get(x, 0) | 1 << k
        masks.append(m)
    return masks


def search(block: Block, masks: list[dict[int, int]], known: Vocabulary, words: np.ndarray, doc: np.ndarray, n_docs: int) -> dict[tuple[int, int], tuple[float, float, float]]:
    """(document, item) of a slice to the best (share of the common subsequence, of the answer, cosine)."""
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    cell, first = cells_of(doc, n_docs)
    feature = known(words)
    rows = Rows(cell, feature, first, block.weight, block.other)
    head = T.doc_starts(doc, n_docs)
    possible = block.possible(feature, cell, first, rows.there, head)
    # A passage's cosine is at most the share of its norm that the features have.
    marked = rows.share >= COSINE**2
    marked[possible // len(block.items)] = True
    near = np.flatnonzero(marked)
    if not len(near):
        return best
    placed = rows.times(block.space, marked)[near]
    for at in range(0, len(near), 2000):
        cosine = placed[at : at + 2000] @ block.placed.T
        close = cosine >= COSINE
        some = possible[slice(*np.searchsorted(possible, np.array([near[at], near[min(at + 2000, len(near)) - 1] + 1]) * len(block.items)))]
        maybe = np.zeros_like(close)
        maybe[np.searchsorted(near, some // len(block.items)) - at, some % len(block.items)] = True
        for row, k in zip(*np.nonzero(close | maybe)):
            c = int(near[at + row])
            d = int(np.searchsorted(first, c, side="right")) - 1
            item, w, answer, reach = block.items[k]
            if best.get((d, item), (0,))[0] >= 1:
                continue
            start = head[d] + (c - first[d]) * CELL
            low, high = max(head[d], start - len(w)), min(head[d + 1], start + 2 * CELL + len(w))
            region = words[low:high].tolist()
            here = set(region)
            if not close[row, k] and sum(x in here for x in w.tolist()) < LCS_WITH_ANSWER * len(w) - 1e-9:
                continue
            ratio = lcs(masks[k], len(w), region) / len(w)
            if len(w) < MIN_WORDS:
                ratio = float(any(region[x : x + len(w)] == w.tolist() for x in range(len(region))))
            if not close[row, k] and ratio < LCS_WITH_ANSWER:
                continue
            if reach > len(w) and len(answer):
                here = set(words[max(head[d], start - reach) : min(head[d + 1], start + 2 * CELL + reach)].tolist())
            share_answer = sum(x in here for x in answer.tolist()) / len(answer) if len(answer) else 0.0
            found = (ratio, share_answer, float(cosine[row, k]))
            best[d, item] = max(best.get((d, item), found), found)
    return best


def _search(blocks: list[Block]):
    masks = [_masks(b) for b in blocks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Vocabulary(b.vocabulary.hashes) for b in blocks]
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            out = []
            for i, j, data, offs in T.slices(batch.column("text"), SLICE):
                words, doc = words_of(data, offs)
                for b, block in enumerate(blocks if len(words) else []):
                    for (d, item), found in search(block, masks[b], known[b], words, doc, j - i).items():
                        out.append((int(ids[i + d]), item, *found))
            columns = list(zip(*out)) if out else [[]] * 5
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["id", "item_id", "lcs_ratio", "answer_share", "cosine"])

    return run


def item_passages(item: int, text: str) -> list[tuple[int, np.ndarray, np.ndarray, int]]:
    """An item as passages of at most three cells of words, each with the item's last sentence as answer."""
    words = text_words(text)
    sentences = [text_words(s) for s in re.split(r"[.!?。！？]+", text)]
    sentences = [s for s in sentences if len(s)]
    answer = sentences[-1] if len(sentences) > 1 else words
    if len(words) <= 3 * CELL:
        return [(item, words, answer, len(words))] if len(words) else []
    return [(item, words[k : k + 2 * CELL], answer, len(words)) for k in range(0, len(words) - CELL, CELL)]


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Block]:
    rows = benchmark.select(id_of(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct().orderBy("id", "text")
    held: list = []
    for row in rows.toLocalIterator():  # a block at a time is in memory
        held += item_passages(row["id"], row["text"])
        while len(held) >= BLOCK_ITEMS:
            yield Block(held[:BLOCK_ITEMS])
            held = held[BLOCK_ITEMS:]
    if held:
        yield Block(held)


HITS = "id long, item_id long, lcs_ratio double, answer_share double, cosine double"


def candidates(docs: DataFrame, benchmark: DataFrame, work: Workspace, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """HITS: every document and item that the cosine search brought together, with the checks."""
    spark: SparkSession = docs.sparkSession
    docs = docs.select(id_of(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found, taken, n = local_rows(spark, [], HITS), blocks(benchmark, item_col, item_text), 0
    while some := list(itertools.islice(taken, SCAN_BLOCKS)):
        vocabulary = np.unique(np.concatenate([b.vocabulary.hashes for b in some]))
        counted = docs.select("text").mapInArrow(_frequencies(vocabulary), "slot int, n long, df binary")
        df, cells = np.zeros(len(vocabulary), dtype=np.int64), 0
        for row in counted.groupBy("slot").applyInArrow(_sum_frequencies(len(vocabulary)), "n long, df binary").collect():
            df += X.unplanes(bytes(row["df"]), len(vocabulary)).astype(np.int64)
            cells += row["n"]
        if not cells:
            return found
        for b in some:
            b.weigh(df[np.searchsorted(vocabulary, b.vocabulary.hashes)], cells)
        slots = X.even_slots(spark, 1)
        parts = docs.select("text").mapInArrow(_project(some, slots), "slot int, b int, r int, z binary")
        summed = parts.groupBy("slot", "b", "r").applyInArrow(_sum_parts, "b int, r int, z binary")
        gathered = [np.zeros((len(b.weight), b.rank), np.float32) for b in some]
        for row in summed.collect():  # features of some blocks by rank
            block = gathered[row["b"]]
            cut = len(block) * np.arange(SUM_RANGES + 1) // SUM_RANGES
            block[cut[row["r"]] : cut[row["r"] + 1]] = np.frombuffer(bytes(row["z"]), np.float32).reshape(-1, block.shape[1])
        for b, sums in zip(some, gathered):
            b.embed(sums, cells)
        found = found.unionByName(work.save(docs.mapInArrow(_search(some), HITS), f"scan{n}"))
        n += 1
    return found


def verdicts(hits: DataFrame) -> DataFrame:
    """One row for each document that has candidates: contaminated, and its best item."""
    bad = (F.col("lcs_ratio") >= LCS_ALONE) | ((F.col("lcs_ratio") >= LCS_WITH_ANSWER) & (F.col("answer_share") >= ANSWER))
    rank = F.struct(bad.alias("contaminated"), "lcs_ratio", "answer_share", F.bitwise_not("item_id").alias("minus_id"), "cosine")
    best = hits.groupBy("id").agg(F.max(rank).alias("b"))
    return best.select("id", "b.contaminated", F.bitwise_not("b.minus_id").alias("item_id"), "b.lcs_ratio", "b.answer_share", "b.cosine")
