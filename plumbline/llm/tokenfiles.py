"""Token ids in parquet files.

One row for each document, in ascending id order over all files: part and row (its place), doc_id,
n_tokens and ids, a list column. Writers use format version 2, so that ids are dictionary-coded and fall
back to delta coding; row groups and pages are small and carry the page index. A reader that asks for
columns or a range of doc_id reads just those pages.

Defined cases: a null text is empty and has the end id alone. Null ids come first. Rows that share an
id follow each other in no fixed order of texts, each with ids of its own. Texts are read whole. Other
columns aren't written. No rows: files without rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm import textscan as T
from plumbline.llm import tokens
from plumbline.llm.substring import text_size
from plumbline.llm.workspace import local_rows, shrink_heaps

PART_BYTES = 48 << 20
#: Chunks that a worker keeps, and bits of the number of places in their table: some 140 MB when full.
KEPT_CHUNKS, KEPT_BITS = 2_000_000, 22
_kept: dict[str, tokens.ChunkCoder] = {}
OPTIONS = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
}


def byte_bpe(model: bytes, workers: int) -> tokens.ChunkCoder:
    """Byte-level BPE splits before each white space that follows another character, whatever else."""
    tokens.threads(workers)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(model.decode())

    # A byte-level token has a character for each byte.
    vocabulary = tokenizer.get_vocab()
    width = np.zeros(max(vocabulary.values()) + 1, np.int64)
    width[list(vocabulary.values())] = [len(t) for t in vocabulary]

    def encode(strings: list[str]) -> list[list[int]]:
        return [x.ids for x in tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    return tokens.ChunkCoder(tokens.together(encode, width, T.SPACE, tokens.after_ascii_or_letter), T.SPACE, tokens.after_ascii_or_letter, KEPT_CHUNKS, KEPT_BITS)


def kept_coder(name: str, model: bytes, workers: int) -> tokens.ChunkCoder:
    """The coder of this process for one write: later tasks of a worker go on with the chunks of its earlier ones;
    another write begins anew."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = byte_bpe(model, workers)
    return _kept[name]


def _encode(model: bytes, end_id: int, workers: int):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, part, row = kept_coder(name, model, workers), TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, j, data, offs in T.slices(batch.column("text")):
                flat, at = coder(data, offs)
                counts = np.diff(at) + 1
                ends = np.cumsum(counts)
                out = np.full(ends[-1], end_id, dtype=np.int32)
                keep = np.ones(len(out), dtype=bool)
                keep[ends - 1] = False
                out[keep] = flat
                ids = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(out, pa.int32()))
                n = j - i
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(row, row + n), pa.int64()), batch.column("doc_id").slice(i, n), pa.array(counts, pa.int64()), ids], ["part", "row", "doc_id", "n_tokens", "ids"])
                row += n
        T.tidy()

    return run


def write(docs: DataFrame, path: str, model_file: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", workers: int = 1) -> None:
    """Encodes every text, appends end_id and writes the files in ascending id order."""
    with open(model_file, "rb") as f:  # the driver's file goes with the tasks
        model = f.read()
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shrink_heaps(docs.sparkSession)
    parts = max(1, -(-text_size(docs) // PART_BYTES))
    ordered = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    coded = ordered.mapInArrow(_encode(model, end_id, workers), "part int, row long, doc_id long, n_tokens long, ids array<int>")
    coded.write.mode("overwrite").options(**OPTIONS).parquet(path)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """(part, row, doc_id, n_tokens) without reading any ids."""
    return spark.read.parquet(path).select("part", "row", "doc_id", "n_tokens")


def read_range(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """(doc_id, ids) for low <= doc_id < high: row groups and pages outside aren't read."""
    return spark.read.parquet(path).where((F.col("doc_id") >= low) & (F.col("doc_id") < high)).select("doc_id", "ids")


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, row, start): ids of all documents before each. Totals of parts, of which there is one
    for each PART_BYTES of text, meet on the driver; documents don't."""
    meta = metadata(spark, path)
    totals = sorted(tuple(r) for r in meta.groupBy("part").agg(F.sum("n_tokens")).collect())
    before, base = 0, []
    for part, total in totals:
        base.append((part, before))
        before += total
    bases = local_rows(spark, base, "part int, base long")
    run = F.sum("n_tokens").over(W.partitionBy("part").orderBy("row")) - F.col("n_tokens")
    return meta.withColumn("run", run).join(F.broadcast(bases), "part").select("part", "row", "doc_id", "n_tokens", (F.col("base") + F.col("run")).alias("start"))


def _checksum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        at, flat = ids.offsets.to_numpy(), np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))
        crc = [zlib.crc32(flat[i:j]) for i, j in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("row"), pa.array(crc, pa.int64())], ["part", "row", "ids_crc32"])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(part, row, ids_crc32) of the ids as unsigned 32-bit little-endian numbers, from the files."""
    return spark.read.parquet(path).select("part", "row", "ids").mapInArrow(_checksum, "part int, row long, ids_crc32 long")
