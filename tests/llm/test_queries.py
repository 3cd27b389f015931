"""The registered queries: those with an SQL twin equal it in DuckDB, the others have a row for each row of their table."""

import os

import duckdb
import pytest

from aerolith.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, data, name):
    duck = duckdb.connect()
    for f in os.listdir(data):
        duck.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{data}/{f}')")
    df = queries.QUERIES[name](spark, data)
    names = sorted(df.columns)
    out = duck.execute(queries.SQL[name])
    columns = [c[0] for c in out.description]
    assert sorted(columns) == names
    expected = sorted((tuple(r[columns.index(c)] for c in names) for r in out.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == expected


@pytest.mark.parametrize("name, table, key, columns", [
    ("op1_bpe", "documents", "doc_id", {"n_tokens", "ids_sha256", "decoded_sha256"}),
    ("op2_token_files", "documents", "doc_id", {"start", "n_tokens", "ids_crc32"}),
    ("op4_quality", "documents", "doc_id", {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"}),
    ("op5_simhash", "documents", "doc_id", {"fingerprint", "component_id"}),
    ("op7_urls", "pages", "page_id", {"host", "path", "rule", "verdict"}),
    ("op9_suffixes", "documents", "doc_id", {"n_bytes", "n_removed", "n_spans", "kept_sha256"}),
])
def test_one_row_for_each(spark, data, name, table, key, columns):
    rows = queries.QUERIES[name](spark, data)
    assert columns | {key} <= set(rows.columns)
    ids = [r[0] for r in spark.read.parquet(f"{data}/{table}.parquet").select(key).collect()]
    assert sorted(r[0] for r in rows.select(key).collect()) == sorted(ids)
