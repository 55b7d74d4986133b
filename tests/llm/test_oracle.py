"""Queries with SQL against DuckDB on the smallest tables; all are registered with their columns."""

import os

import duckdb
import pytest

import __spark_entry__
from traitscope.llm.oracle import oracle
from traitscope.llm.queries import REGISTRY


@pytest.mark.parametrize("name", sorted(oracle()))
def test_query(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(folder, t)}.parquet'")
    df = REGISTRY[name](spark, folder)
    columns = sorted(df.columns)
    result = con.execute(oracle()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=repr)
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == want


def test_all_operators_and_the_pipeline_are_registered():
    names = list(__spark_entry__.queries())
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names
