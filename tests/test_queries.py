"""Registered queries against their SQL in DuckDB, on the smallest tables: all of them."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from wardfield import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier orders lineitem embeddings".split()
NAMES = list(catalog.QUERIES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    want = duck.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = table(df.columns, df.collect())
    assert got and got == table(want.columns, want.fetchall())


def test_entry_points_need_no_session_to_import():
    code = ("import __spark_entry__ as e; from wardfield import catalog as c; "
            "assert set(c.QUERIES) == set(c.SQL) <= set(e.queries()); assert set(e.oracle_sql()) <= set(e.queries())")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)
