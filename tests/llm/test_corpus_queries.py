"""The registered queries: against SQL where there is some, else that each whole table comes back."""

import os
import zlib

import pytest

from kelpie.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    rel = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in df.columns]
    assert sorted(str([r[i] for i in order]) for r in rel.fetchall()) == sorted(str(list(r)) for r in df.collect())


@pytest.mark.parametrize("name", ["op2_toxicity", "op3_lm_scoring", "op5_media_columns", "op9_suffix_dedup"])
def test_one_row_a_document(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).collect()
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect())
    assert sorted(r.doc_id for r in rows) == ids
    if name == "op2_toxicity":
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    if name == "op3_lm_scoring":
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows)
        unseen = [r for r in rows if r.held_out]
        assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
