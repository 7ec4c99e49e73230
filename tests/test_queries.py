"""Every query of the core against its SQL on the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from palatine.plans import oracles, queries


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, data, duck, name):
    df = queries.queries()[name](spark, data)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    sql = oracles.oracle_sql().get(name)
    if sql is None:
        assert got[1]
        return
    rel = duck.sql(sql)
    assert got == _rows(rel.columns, rel.fetchall())
