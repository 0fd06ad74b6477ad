"""Shared working storage: tables that cut lineage, in the folder that the cluster names."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Rows of whole texts in one batch to Python, where the session has Spark's default of 10,000.
BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
#: Bytes of one batch, where the session sets none, so that very long texts come a few at a time.
BYTES_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
_batch_bytes: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only in local mode, where none is set."""
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set(CHECKPOINT_KEY, root)
    return root.rstrip("/")


def text_batches(spark: SparkSession) -> None:
    """Batches of whole texts are kept small, unless the session says otherwise."""
    if spark.conf.get(BATCH_KEY) == "10000":
        spark.conf.set(BATCH_KEY, BATCH_ROWS)
    if spark.sparkContext.applicationId not in _batch_bytes:
        _batch_bytes.add(spark.sparkContext.applicationId)
        if not spark.sparkContext.getConf().contains(BYTES_KEY):
            spark.conf.set(BYTES_KEY, BATCH_BYTES)


#: Seconds between two collections of the executors' heaps.
COLLECT_EVERY = 5
_collected = 0.0


def shrink_heaps(spark: SparkSession, now: bool = False) -> None:
    """Executors collect their heaps, which gives the system what the steps before have left free: a heap that has
    grown to its limit leaves Python workers little. Local mode has the driver's heap alone."""
    global _collected
    if spark.sparkContext.master.startswith("local[") or not now and time.time() < _collected + COLLECT_EVERY:
        return
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).selectExpr("java_method('java.lang.System', 'gc')").write.format("noop").mode("overwrite").save()
    _collected = time.time()


def _forget(work: Workspace) -> None:
    try:
        work.drop("")
    except Exception:  # noqa: BLE001 - the JVM may be gone by now
        pass


#: Rows of ids and labels in a file, and bytes of texts whose results go to one file: a table is written in as many
#: files as its size needs, not in one for each shuffle partition.
FILE_ROWS, FILE_TEXT = 200_000, 16 << 20


def files_of(rows: int = 0, text: int = 0) -> int:
    return max(1, -(-rows // FILE_ROWS), -(-text // FILE_TEXT))


_ARROW = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows of the driver, "name type, ..."; by Arrow, as lists of rows pass through Python workers,
    which then stay in the executors' memory."""
    fields = [(f.split()[0], _ARROW[f.split()[1]]) for f in schema.split(",")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return spark.createDataFrame(pa.table([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields]))


class Workspace:
    """Named parquet tables below the shared folder, for one run of an operator. Results are read from them, so
    they are removed when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        text_batches(spark)
        self.root = f"{shared_root(spark)}/plumbline-{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(_forget, self)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def save(self, df: DataFrame | Callable[[], DataFrame], table: str, small: bool = False, files: int | None = None) -> DataFrame:
        """Writes df and reads it back: lost executors repeat tasks, never the lineage before. Given a
        function that makes df, nothing holds on to the plan afterwards and its shuffle files can go; for small
        tables that isn't worth a collection. files: how many at most. Working tables are ids, hashes and packed
        bytes, which don't compress; the codec's buffers would stay in the executors' memory outside the heap."""
        made = df() if callable(df) else df
        if files is not None:
            made = made.coalesce(files)
        made.write.mode("overwrite").option("compression", "uncompressed").parquet(self.path(table))
        del made, df
        if not small:
            self.release()
        return self.spark.read.parquet(self.path(table))

    def release(self) -> None:
        """Lets Spark's cleaner drop the shuffle files of plans that nothing refers to any more."""
        for _ in range(2):
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.15)
        shrink_heaps(self.spark)

    def only(self, df: DataFrame, table: str) -> DataFrame:
        """Writes df and removes all other tables, which it may have been made of."""
        out = self.save(df, table, small=True)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        for entry in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path):
            if entry.getPath().getName() != table:
                self.drop(entry.getPath().getName())
        self.release()
        return out

    def drop(self, table: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(table))
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
