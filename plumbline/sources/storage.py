"""Shared storage for operators that write: the folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

KEY = "spark.checkpoint.dir"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the cluster's shared folder; one of our own only where none is set."""
    root = spark.conf.get(KEY, None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set(KEY, root)
    return f"{root.rstrip('/')}/plumbline-{name}-{uuid.uuid4().hex[:12]}"
