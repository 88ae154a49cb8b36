"""Every query of the catalogue against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from meshvec.plans import catalogue


@pytest.fixture(scope="session")
def db(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([r[i] for i in order] for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, sf_dir, db, name):
    got = catalogue.QUERIES[name](spark, sf_dir)
    want = db.execute(catalogue.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
