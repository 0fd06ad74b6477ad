"""Sources and sinks: corpora, samples, logs, whole files, configuration, results."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = "id string, label string, lang string, type string, genre string, text string, source string, known_fn boolean"
STORE = "signal_id string, sample_hash string, note string, date string, added_by string"
STEPS = "iter int, score_after double, score double, budget_used double, edits_pct double, action string"


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """Labelled JSON lines."""
    return spark.read.schema(CORPUS).json(path)


def samples(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with `text` or `response`; blank ones go, model and domain default to unknown."""
    raw = spark.read.schema("text string, response string, model string, domain string").json(path)
    unknown = F.lit("unknown")
    out = raw.select(F.coalesce("text", "response").alias("text"), F.coalesce("model", unknown).alias("model"), F.coalesce("domain", unknown).alias("domain"))
    return out.where(F.trim("text") != "")


def review_store(spark: SparkSession, path: str) -> DataFrame:
    """Reviewed false positives; a store that isn't there is empty."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], STORE)
    return spark.read.schema(STORE).json(path)


def add_review(spark: SparkSession, path: str, signal_id: str, text: str, note: str, date: str, by: str) -> None:
    row = spark.createDataFrame([(signal_id, text, note, date, by)], "signal_id string, t string, note string, date string, added_by string")
    row.select("signal_id", F.substring(F.sha2("t", 256), 1, 16).alias("sample_hash"), "note", "date", "added_by").coalesce(1).write.mode("append").json(path)


def loop_steps(spark: SparkSession, pattern: str) -> DataFrame:
    """Steps of rewriting loops from runs/*/iterations.jsonl: the run is the folder's name."""
    raw = spark.read.schema(STEPS).json(pattern).withColumn("path", F.col("_metadata.file_path"))
    out = raw.where("action is null or action <> 'exit_ok'")
    return out.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("run_id"), "iter", F.coalesce("score_after", "score").alias("score"), F.coalesce("budget_used", "edits_pct", F.lit(0.0)).alias("edits_pct"), F.coalesce("action", F.lit("accepted")).alias("action"))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def write_results(df: DataFrame, path: str) -> None:
    """One JSON object for each row."""
    df.write.mode("overwrite").json(path)


@dataclass(frozen=True)
class Settings:
    """Decision threshold and short-text minimums; missing or wrong values fail before any job."""

    threshold: float
    guards: dict[str, int]

    NAMES = ("min_words_density", "min_words_repetition", "min_sentences_burstiness", "min_words_burstiness", "min_sentences_punctuation", "min_words_trailing_moral", "min_lines_list_heavy")

    @classmethod
    def read(cls, path: str) -> Settings:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        threshold = raw.get("threshold")
        if isinstance(threshold, bool) or not isinstance(threshold, (int, float)) or not 0 < threshold <= 1:
            raise ValueError(f"threshold must be a number above 0 and at most 1: {threshold!r}")
        guards = raw.get("short_text_guards")
        if not isinstance(guards, dict):
            raise ValueError("short_text_guards is missing")
        for name in cls.NAMES:
            if isinstance(guards.get(name), bool) or not isinstance(guards.get(name), int) or guards[name] < 1:
                raise ValueError(f"short_text_guards.{name} must be a positive whole number")
        return cls(float(threshold), {n: guards[n] for n in cls.NAMES})


@dataclass(frozen=True)
class ProjectConfig:
    """A project's slop.json: signals off, terms allowed, weights and aggregation."""

    disabled_signals: tuple[str, ...] = ()
    term_allowlist: tuple[str, ...] = ()
    weight_overrides: tuple[tuple[str, float], ...] = ()
    aggregation: str = "weighted"
    epsilon: float = 0.05

    @classmethod
    def read(cls, path: str, weights: set[str]) -> ProjectConfig:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        if not isinstance(raw, dict) or set(raw) - {"disabled_signals", "term_allowlist", "weight_overrides", "aggregation"}:
            raise ValueError(f"unknown keys: {sorted(set(raw) - {'disabled_signals', 'term_allowlist', 'weight_overrides', 'aggregation'})}")
        for key in ("disabled_signals", "term_allowlist"):
            if not all(isinstance(x, str) for x in raw.get(key, [])):
                raise ValueError(f"{key} must list strings")
        override = raw.get("weight_overrides", {})
        if set(override) - weights or not all(isinstance(v, (int, float)) and v >= 0 for v in override.values()):
            raise ValueError("weight_overrides must give known dimensions weights of 0 or more")
        mode = raw.get("aggregation", "weighted")
        epsilon = mode.get("epsilon", 0.05) if isinstance(mode, dict) else 0.05
        mode = mode.get("mode", "weighted") if isinstance(mode, dict) else mode
        if mode not in ("weighted", "geomean") or not 0 < epsilon < 1:
            raise ValueError("aggregation must be weighted or geomean, with 0 < epsilon < 1")
        return cls(tuple(raw.get("disabled_signals", ())), tuple(raw.get("term_allowlist", ())), tuple(sorted(override.items())), mode, epsilon)
