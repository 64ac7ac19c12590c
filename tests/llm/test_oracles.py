"""The SQL of the text operators gives the rows of their queries."""

from __future__ import annotations

import duckdb
import pytest

from docketry.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles_agree(spark, small, name):
    con = duckdb.connect()
    for table in ("embeddings", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    ours = queries.queries()[name](spark, small)
    columns = sorted(ours.columns)
    theirs = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, ours.select(*columns).collect()))) == sorted(map(str, theirs)) and theirs
