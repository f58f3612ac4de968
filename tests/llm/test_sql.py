"""Operators that SQL can express, against DuckDB on the smallest tables; every query's columns, as its contract names them."""

import duckdb
import pytest

from tidemark.llm import registry

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op3": "doc_id keep_id group_size kept text_sha256", "op5": "doc_id size source_size target taken", "op7": "query_id rank vec_id score", "op8": "doc_id held_out score predicted",
    "op9": "doc_id held_out n_tokens n_known train_tokens base_score score", "op10": "doc_id piece start length ids_crc32 sequence_id offset",
    "op11": "doc_id leaf subroot root proof_sha256 folded_root verified", "op12": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op13": "doc_id lang source text_sha256 n_clean n_edit_edit n_edit_delete n_insert_insert",
}


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLE_SQL[name])
    names = sorted(df.columns)
    assert sorted(want.columns) == names
    rows = lambda columns, data: sorted((tuple(r[columns.index(c)] for c in names) for r in data), key=repr)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("op", sorted(COLUMNS))
def test_columns(spark, op):
    name = next(n for n in registry.QUERIES if n.startswith(f"{op}_"))
    assert set(COLUMNS[op].split()) <= set(registry.QUERIES[name](spark, SF).columns)
