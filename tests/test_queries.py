"""Every registered lakehouse query against its SQL on a second engine."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from millrace.plans import queries as q


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return c


def text(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = q.QUERIES[name](spark, sf_dir)
    columns, rows = sorted(df.columns), df.collect()
    if name not in q.ORACLE_SQL:
        assert rows
        return
    found = con.execute(q.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(text(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(text(r[c]) for c in columns) for r in rows) == want


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
