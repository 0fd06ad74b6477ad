"""Sharding by best-fit-decreasing bin packing.

Groups that can't be divided, here rows of equal text, are sorted by size; each enters the bin with the
tightest remaining capacity that holds it, found in a balanced tree, and opens a bin when none does. For a
fixed number of shards, the smallest capacity that needs no more bins is searched.

Groups of one size are alike to the packer, so it gets classes (size, number of groups) and deals each class in
runs: after a group entered the tightest bin, that bin is the tightest for the next group as long as it
has room. This gives what packing group by group gives. The driver holds one entry for each distinct size, at
most the root of twice the bytes of the corpus (as so many different sizes have that sum), never the groups. Groups
of a class that is dealt to several bins are ranked by their hash to find their run.

Defined cases: a null text has size 1 and is one group; an empty text is another. Null ids are rows like
others. Repeated rows lie in one shard and get slots of their own. Ties of size go by the hash of the text, of
bins by the order in which they were opened. Empty tables give no rows. Other columns play no part.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.components import spread
from plumbline.llm.workspace import Workspace, local_rows

#: Groups with more than one in so many of all rows, which are broadcast apart; rows of a chunk, and the fewest chunks.
HOT, CHUNK_ROWS, LEAST_CHUNKS = 2000, 50_000, 256


class Tree:
    """A treap of (remaining capacity, bin): balanced in expectation, by fixed pseudo-random ranks."""

    def __init__(self) -> None:
        self.root: list | None = None
        self.rank = random.Random(41).random

    def _split(self, node, key):
        """Nodes below key, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def _join(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._join(a[3], b)
            return a
        b[2] = self._join(a, b[2])
        return b

    def add(self, key: tuple[int, int]) -> None:
        left, right = self._split(self.root, key)
        self.root = self._join(self._join(left, [key, self.rank(), None, None]), right)

    def take_at_least(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the smallest key whose capacity holds size."""
        left, right = self._split(self.root, (size, -1))
        if right is None:
            self.root = left
            return None
        node = right
        while node[2] is not None:
            node = node[2]
        key = node[0]
        _, rest = self._split(right, (key[0], key[1] + 1))
        self.root = self._join(left, rest)
        return key


def best_fit_decreasing(classes: list[tuple[int, int]], capacity: int) -> list[list[tuple[int, int]]]:
    """For each class (size, count) its runs (bin, count); sizes in descending order. An item above the
    capacity gets a bin of its own."""
    tree, bins, out = Tree(), 0, []
    for size, count in classes:
        runs: list[tuple[int, int]] = []
        while count:
            found = tree.take_at_least(size)
            if found is None:
                found, bins = (max(capacity, size), bins), bins + 1
            n = min(count, found[0] // size)
            runs.append((found[1], n))
            tree.add((found[0] - n * size, found[1]))
            count -= n
        out.append(runs)
    return out


def bins_of(packed: list[list[tuple[int, int]]]) -> int:
    return 1 + max((b for runs in packed for b, _ in runs), default=-1)


def pack_into(classes: list[tuple[int, int]], shards: int) -> list[list[tuple[int, int]]]:
    """Best-fit-decreasing at the smallest capacity that needs at most so many bins."""
    if not classes:
        return []
    low = max(-(-sum(s * c for s, c in classes) // shards), classes[0][0])
    high, best = low, None
    while best is None:
        placed = best_fit_decreasing(classes, high)
        if bins_of(placed) <= shards:
            best = placed
        else:
            low, high = high + 1, high + max(1, high // 64)
    while low < high:
        middle = (low + high) // 2
        placed = best_fit_decreasing(classes, middle)
        if bins_of(placed) <= shards:
            best, high = placed, middle
        else:
            low = middle + 1
    return best


def assign(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, shard, slot) for each row; slots count from 0 in each shard."""
    spark = docs.sparkSession
    work = Workspace(spark, "sharding")
    text = F.col(text_col).cast("string")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), size.alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"), F.when(text.isNull(), F.lit(0)).otherwise(F.xxhash64(text)).alias("key"))
    rows = work.save(rows, "rows")
    count = rows.count()
    groups = work.save(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "groups")
    listed = sorted(((r["bytes"], r["n"]) for r in groups.groupBy("bytes").agg(F.count("*").alias("n")).collect()), reverse=True)  # a row a distinct size
    packed = pack_into(listed, shards)
    whole = [(size, runs[0][0]) for (size, _), runs in zip(listed, packed) if len(runs) == 1]
    parted = [(size, b, sum(n for _, n in runs[:k]), sum(n for _, n in runs[: k + 1])) for (size, _), runs in zip(listed, packed) if len(runs) > 1 for k, (b, _) in enumerate(runs)]
    placed = spread(groups, "bytes", local_rows(spark, whole, "root long, shard int"), "shard", by="key")
    ranked = ranks(placed.where("shard is null").select("key", "bytes", "n"), count)
    runs = F.broadcast(local_rows(spark, parted, "size long, run int, low long, high long"))  # fewer rows than sizes and shards together
    split = ranked.join(runs, (F.col("bytes") == F.col("size")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).select("key", "bytes", "n", F.col("run").alias("shard"))
    placed = work.save(placed.where("shard is not null").select("key", "bytes", "n", "shard").unionByName(split), "placed")
    hot = F.broadcast(placed.where(F.col("n") > count // HOT).select("key", "shard"))  # fewer than HOT groups
    usual = rows.join(hot.select("key"), "key", "left_anti").join(placed.where(F.col("n") <= count // HOT).select("key", "shard"), "key")
    put = usual.select("id", "size", "crc", "shard").unionByName(rows.join(hot, "key").select("id", "size", "crc", "shard"))
    chunks = max(LEAST_CHUNKS, -(-count // (shards * CHUNK_ROWS)))
    put = work.save(put.select("*", F.pmod(F.xxhash64("id", "size", "crc", F.monotonically_increasing_id()), F.lit(chunks)).cast("int").alias("chunk")), "put")
    before = put.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = before.withColumn("base", F.sum("n").over(W.partitionBy("shard").orderBy("chunk")) - F.col("n")).select("shard", "chunk", "base")
    within = F.row_number().over(W.partitionBy("shard", "chunk").orderBy("id", "size", "crc")) - 1
    out = put.withColumn("within", within).join(before, ["shard", "chunk"])
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("base") + F.col("within")).cast("long").alias("slot"))


def ranks(groups: DataFrame, count: int) -> DataFrame:
    """groups with their rank by key, from 0, among groups of the same bytes: ranks within ranges of the key, of
    which each starts where those before it end."""
    ranges = max(LEAST_CHUNKS, -(-count // CHUNK_ROWS))
    cut = groups.withColumn("range", F.floor((F.shiftrightunsigned("key", 32) * ranges) / F.lit(1 << 32)).cast("int"))
    before = cut.groupBy("bytes", "range").agg(F.count("*").alias("m"))
    before = before.select("bytes", "range", (F.sum("m").over(W.partitionBy("bytes").orderBy("range")) - F.col("m")).alias("base"))
    own = F.row_number().over(W.partitionBy("bytes", "range").orderBy("key")) - 1
    return cut.withColumn("own", own).join(before, ["bytes", "range"]).select(*groups.columns, (F.col("base") + F.col("own")).alias("rank"))
