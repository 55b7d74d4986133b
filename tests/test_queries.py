"""Every query with SQL against DuckDB on the smallest tables, the others for their columns."""

import math
import os

import duckdb
import pytest

from catalog.oracle import oracle
from catalog.queries import REGISTRY

TABLES = "part documents embeddings labels conversations events".split()
SLOW = {"fit_clusters", "fit_labels", "fit_trend", "evaluate"}


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(folder, t)}.parquet'")
    return con


def plain(row):
    return tuple(("nan" if math.isnan(v) else v + 0.0) if isinstance(v, float) else v for v in row)


def test_oracle_names_are_queries():
    assert set(oracle()) <= set(REGISTRY)


@pytest.mark.parametrize("name", [n for n in REGISTRY if n not in SLOW])
def test_query(spark, folder, duck, name):
    df = REGISTRY[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted((plain(r) for r in df.select(*columns).collect()), key=repr)
    sql = oracle().get(name)
    if sql is None:
        assert got and columns
        return
    result = duck.execute(sql)
    names = [c[0] for c in result.description]
    order = [names.index(c) for c in columns]
    assert sorted(names) == columns
    want = sorted((plain([r[i] for i in order]) for r in result.fetchall()), key=repr)
    assert got == want
