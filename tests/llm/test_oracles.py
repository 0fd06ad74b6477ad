"""The queries that have SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from plumbline.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_duckdb(spark, name):
    rows = queries.queries()[name](spark, DATA).collect()
    db = duckdb.connect()
    for t in ("documents", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    cursor = db.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(repr([r[c] for c in names]) for r in rows) == sorted(repr(list(r)) for r in cursor.fetchall())
