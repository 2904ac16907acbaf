"""The cases on literal rows."""

import cases_operators  # noqa: F401
import cases_retrieval  # noqa: F401
import cases_rules  # noqa: F401
import duckdb
import pytest
from cases import CASES
from test_queries import plain


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    made, sql = CASES[name]
    df, rel = made(spark), duckdb.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in df.columns]
    assert sorted([plain(v) for v in r] for r in df.collect()) == sorted([plain(r[i]) for i in order] for r in rel.fetchall())
