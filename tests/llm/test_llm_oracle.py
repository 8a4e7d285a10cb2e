"""Queries that SQL can express whole, against their DuckDB twins; and what all queries return."""

from collections import Counter

import duckdb
import pytest

from scanweft.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    out = QUERIES[name](spark, DIR)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(out.columns)
    assert Counter(map(tuple, out.select(want.columns).collect())) == Counter(want.fetchall())


#: The columns of the contracts, with their types.
COLUMNS = {
    "op1_": "doc_id:bigint start:bigint n_tokens:bigint ids_crc32:bigint",
    "op2_": "doc_id:bigint n_words:bigint word_chars:bigint n_symbols:bigint n_dup_lines:bigint n_repeat_words:bigint base_failed:boolean kept:boolean",
    "op3_": "doc_id:bigint size:bigint text_crc32:bigint law:string shard:int slot:bigint grown_shard:int",
    "op4_": "doc_id:bigint n_words:bigint n_removed:bigint kept_sha256:string",
    "op5_": "doc_id:bigint n_assign:bigint n_access:bigint n_hex:bigint base_sha256:string spans:string",
    "op6_": "doc_id:bigint kept:boolean",
    "op7_": "doc_id:bigint start:bigint length:bigint ids_crc32:bigint doc_tokens:bigint sequence_id:bigint offset:bigint",
    "op8_": "doc_id:bigint n_tokens:bigint ids_sha256:string decoded_sha256:string",
    "op9_": "doc_id:bigint n_shingles:bigint component_id:bigint",
    "op10_": "vec_id:bigint n_links:bigint component_id:bigint kept:boolean",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, sf_dir, name):
    out = QUERIES[name](spark, sf_dir)
    types = dict(out.dtypes)
    for c in COLUMNS[name.split("_")[0] + "_"].split():
        column, kind = c.split(":")
        assert types[column] == kind
    rows = spark.read.parquet(f"{sf_dir}/{'embeddings' if name.startswith('op10_') else 'documents'}.parquet").count()
    assert out.count() == rows or name.startswith("op7_")
