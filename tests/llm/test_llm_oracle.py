"""Operators that SQL can express, against DuckDB."""

import duckdb
import pytest

from tallyspark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, small_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small_dir}/documents.parquet'")
    found = con.execute(queries.ORACLE[name])
    names = [c[0] for c in found.description]
    want = found.fetchall()
    got = [tuple(r) for r in queries.QUERIES[name](spark, small_dir).select(*names).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
