"""Every registered query against its DuckDB oracle on the sf0.001 tables
(row count, column names, order-insensitive value hash)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from scripts.oracle_check import TABLES, digest
from tallyspark.plans.registry import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"
E.queries()  # registers the plans
KEYS = sorted(QUERIES)  # the training-data queries are tested in tests/llm


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SMALL, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_has_oracle_sql():
    assert set(ORACLE) == set(QUERIES)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "party_name" in df.columns


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    """Same column names, same Arrow types, same rows (order-insensitive)."""
    tbl = E.queries()[key](spark, SMALL).toArrow()
    dtbl = con.sql(E.oracle_sql()[key]).to_arrow_table()
    assert sorted(tbl.column_names) == sorted(dtbl.column_names)
    dtypes = {f.name: f.type for f in dtbl.schema}
    for f in tbl.schema:
        assert f.type == dtypes[f.name], f"{f.name}: spark {f.type} vs oracle {dtypes[f.name]}"
    rows = [tuple(r.values()) for r in tbl.to_pylist()]
    drows = [tuple(r.values()) for r in dtbl.to_pylist()]
    assert len(rows) == len(drows)
    assert digest(tbl.column_names, rows)[0] == digest(dtbl.column_names, drows)[0]
