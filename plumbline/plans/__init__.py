"""Every registered query: SQL operators with their check, and operators in Python."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans.catalog import OPERATORS

MODULES = ["structure", "matching", "scoring", "signals", "evaluation", "events", "detection"]


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"plumbline.operators.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from plumbline.plans import python_queries

    load()
    return {name: op.run for name, op in OPERATORS.items()} | python_queries.queries()


def oracles() -> dict[str, str]:
    from plumbline.plans import python_queries

    load()
    return {name: op.oracle() for name, op in OPERATORS.items()} | python_queries.oracles()
