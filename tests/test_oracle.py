"""Every query that has SQL, beside DuckDB over the same tables."""

import glob
import os

import duckdb
import pytest

from geomosaic.plans import registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def in_order(rows):
    return sorted(tuple(repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_rows_equal_duckdb(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    cur = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = in_order(cur.fetchall())
    assert in_order([tuple(r[c] for c in names) for r in df.collect()]) == want
    assert want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_queries_without_sql_have_rows(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).limit(1).count() == 1


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
