"""Every query with SQL against DuckDB on the smallest tables, and the driver contract."""

import datetime
import decimal
import importlib
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()
OWN = sorted(k for k in QUERIES if not k.startswith("op") and k != "pipeline")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


def rows_of(names, rows):
    return sorted((tuple(plain(r[i]) for i in names) for r in rows), key=repr)


@pytest.mark.parametrize("name", [k for k in OWN if k in SQL])
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = rows_of([df.columns.index(c) for c in names], df.collect())
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == names
    assert got == rows_of([want.columns.index(c) for c in names], want.fetchall())


@pytest.mark.parametrize("name", [k for k in OWN if k not in SQL])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_sql_only_for_known_queries():
    assert set(SQL) <= set(QUERIES)


def test_nothing_else_imports_llm():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    found = []
    for folder, _, names in os.walk(f"{root}/tidemark"):
        if not folder.startswith(f"{root}/tidemark/llm"):
            found += [f"{folder}/{n}" for n in names if n.endswith(".py") and "tidemark.llm" in open(f"{folder}/{n}").read()]
    assert not found
    importlib.import_module("tidemark.plans.registry")
