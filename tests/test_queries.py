"""Every registered query of the engine against its SQL."""

import math
import os

import duckdb
import pytest

from bramble.plans import queries, sql


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{small}/{f}')")
    return c


def clean(rows, order):
    put = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(put(r[k]) for k in order) for r in rows), key=repr)


def test_every_query_has_sql():
    assert queries.QUERIES.keys() == sql.SQL.keys()


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, small, duck, name):
    got = queries.QUERIES[name](spark, small)
    want = duck.sql(sql.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    a = clean([r.asDict() for r in got.collect()], order)
    b = clean([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()], order)
    assert a == b


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
