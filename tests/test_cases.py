"""The operators on literal cases, against the rows that must come out."""

import cases
import duckdb
import pytest
from test_queries import rows_of


@pytest.mark.parametrize("name", sorted(cases.QUERIES))
def test_case(spark, name):
    df = cases.QUERIES[name](spark, "")
    want = duckdb.sql(cases.ORACLE_SQL[name])
    names = sorted(df.columns)
    assert sorted(want.columns) == names
    assert rows_of([df.columns.index(c) for c in names], df.collect()) == rows_of([want.columns.index(c) for c in names], want.fetchall())
