import os

import duckdb
import pytest

from bramble.llm import queries


@pytest.mark.parametrize("name", queries.SQL)
def test_query_against_sql(spark, small, name):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{small}/{f}')")
    got, want = queries.QUERIES[name](spark, small), c.sql(queries.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order, put = sorted(got.columns), lambda v: round(v, 9) if isinstance(v, float) else v
    a = sorted((tuple(put(r[k]) for k in order) for r in got.collect()), key=repr)
    b = sorted((tuple(put(dict(zip(want.columns, r, strict=True))[k]) for k in order) for r in want.fetchall()), key=repr)
    assert a == b
