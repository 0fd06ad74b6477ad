"""Registry of operators: one SQL text, for Spark and for the check."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from plumbline.functions.dialect import DUCK, PLAIN_DUCK, Spark

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


SEEDED = "_seeded"


@dataclass
class Operator:
    """An operator over tables. Its own texts are read as they are; only as `..._seeded`, which tests semantics on a
    corpus without a phrase of the lexicons, it appends example sentences."""

    name: str
    tables: tuple[str, ...]
    sql: Callable[[Spark], str]
    #: Makes the result of the tables in Spark, where SQL alone would exchange too much; the check stays SQL.
    made: Callable[..., DataFrame] | None = None

    @property
    def seeded(self) -> bool:
        return self.name.endswith(SEEDED)

    def frame(self, spark: SparkSession, **tables: DataFrame) -> DataFrame:
        """The operator over the given tables, in a name space of its own."""
        if self.made:
            return self.made(spark, **tables)
        names = {t: f"{t}_{uuid.uuid4().hex[:12]}" for t in self.tables}
        for t, view in names.items():
            tables[t].createOrReplaceTempView(view)
        sql = self.sql(Spark(self.seeded, spark))
        for t, view in names.items():
            sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {view}", sql)
        try:
            return spark.sql(sql)
        finally:
            for view in names.values():
                spark.catalog.dropTempView(view)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.frame(spark, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in self.tables})

    def oracle(self) -> str:
        return self.sql(DUCK if self.seeded else PLAIN_DUCK)


OPERATORS: dict[str, Operator] = {}


def operator(*tables: str, made: Callable[..., DataFrame] | None = None):
    """Registers a function of the dialect under its own name, and one named ..._seeded without that ending as well."""

    def add(sql: Callable[[Spark], str]):
        for name in {sql.__name__, sql.__name__.removesuffix(SEEDED)}:
            OPERATORS[name] = Operator(name, tables or ("documents",), sql, made)
        return sql

    return add
