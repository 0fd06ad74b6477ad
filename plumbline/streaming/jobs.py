"""Streaming twins of batch operators: the same SQL over micro-batches, windows and keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from plumbline.functions.dialect import SPARK
from plumbline.operators.structure import seven
from plumbline.sources.storage import scratch

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def scored(stream: DataFrame) -> DataFrame:
    """(doc_id, overall) of each document as it comes: no state."""
    stream.createOrReplaceTempView("documents")
    return stream.sparkSession.sql(f"{seven(SPARK)} SELECT doc_id, overall FROM scored")


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs the stream over what is there and returns what it wrote. In complete mode the last result
    stands; in append mode all rows do."""
    spark = stream.sparkSession
    path = scratch(spark, name)
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-state").trigger(availableNow=True).start()
    else:
        query = stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(path)).option("checkpointLocation", path + "-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(path)


def event_windows(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events of each type by tumbling window; rows later than the watermark don't count."""
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def user_sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Bursts: sessions of a user's events without a gap."""
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n"))


STATE = "last double, small int, rollbacks int"
VERDICT = "run_id long, iter long, verdict string"


def guard(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State of a run: the last accepted score, the run of small changes and the run of rollbacks."""
    last, small, rollbacks = state.get if state.exists else (None, 0, 0)
    out = []
    for frame in batches:
        for row in frame.sort_values("iter").itertuples():
            verdict = "ok"
            rollbacks = rollbacks + 1 if row.action == "rollback" else 0
            if row.action == "accepted":
                if last is not None:
                    fall = last - row.score
                    small = small + 1 if abs(fall) < 0.02 else 0
                    if fall > 0.4 and row.edits < 0.5 * fall:
                        verdict = "escalate"
                    elif small >= 3:
                        verdict = "stop_report"
                last = row.score
            if rollbacks >= 2:
                verdict = "escalate"
            out.append((key[0], row.iter, verdict))
    state.update((last, small, rollbacks))
    yield pd.DataFrame(out, columns=["run_id", "iter", "verdict"])


def guarded(steps: DataFrame) -> DataFrame:
    """Steps (run_id, iter, score, edits, action) to the verdict at each step."""
    return steps.groupBy("run_id").applyInPandasWithState(guard, VERDICT, STATE, "append", "NoTimeout")


def stream_scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drain(scored(spark.readStream.schema(DOCUMENTS).parquet(f"{sf_dir}/documents*.parquet")), "scored")


def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drain(event_windows(spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/events*.parquet")), "windows", "complete")
    return out.select(F.unix_micros("w.start").alias("start_us"), "event_type", "n")


def stream_user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drain(user_sessions(spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/events*.parquet")), "sessions", "complete")
    return out.select("user_id", F.unix_micros("w.start").alias("start_us"), "n")
