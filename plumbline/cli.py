"""Commands for spark-submit over a corpus (see COMMANDS), and info; exit code 1 on a failed gate.

    spark-submit --py-files plumbline.zip plumbline/cli.py score corpus.parquet --fail-over 0.7
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import plans
from plumbline.plans.catalog import OPERATORS

#: What each command runs over the texts as they are.
COMMANDS = {"score": "doc_structural_score", "total": "score_with_floors", "classify": "signals_noisy_or", "signals": "classifier_signals", "check": "rhetorical_findings", "gates": "gate_results", "paste": "paste_artifacts"}


def read(spark: SparkSession, path: str) -> DataFrame:
    """Parquet with doc_id and text, JSON lines with text, or whole text files."""
    if path.endswith((".parquet", "/")):
        return spark.read.parquet(path)
    if path.endswith((".json", ".jsonl")):
        docs = spark.read.json(path)
    else:
        docs = spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")
    return docs if "doc_id" in docs.columns else docs.withColumn("doc_id", F.monotonically_increasing_id())


def main(argv: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="plumbline")
    parser.add_argument("command", choices=[*COMMANDS, "info"])
    parser.add_argument("path", nargs="?")
    parser.add_argument("--out")
    parser.add_argument("--fail-over", type=float)
    args = parser.parse_args(argv)
    plans.load()
    if args.command == "info":
        print("\n".join(sorted(OPERATORS)))
        return 0
    spark = SparkSession.builder.appName("plumbline").getOrCreate()
    docs = read(spark, args.path)
    for name in ("lang", "source"):
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(None).cast("string"))
    found = OPERATORS[COMMANDS[args.command]].frame(spark, documents=docs)
    if args.out:
        found.write.mode("overwrite").json(args.out)
    else:
        found.show(50, truncate=False)
    column = next((c for c in ("overall", "score") if c in found.columns), None)
    return int(bool(args.fail_over is not None and column and not found.where(F.col(column) >= args.fail_over).isEmpty()))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
