"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from ledgerloom import catalog


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    return x


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i].lower())
    return [columns[i] for i in order], sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, db, name):
    df = catalog.queries()[name](spark, sf_dir)
    columns, rows = df.columns, [tuple(r) for r in df.collect()]
    assert rows
    if name in catalog.oracle_sql():
        want = db.sql(catalog.oracle_sql()[name])
        assert table(columns, rows) == table(want.columns, want.fetchall())
