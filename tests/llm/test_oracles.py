"""Every training-data query that SQL can express, against its SQL on whole small tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from palatine.llm import oracles, queries


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(round(r[i], 5) if isinstance(r[i], float) else r[i] for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query(spark, data, name):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = queries.queries()[name](spark, data)
    rel = c.sql(oracles.oracle_sql()[name])
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(rel.columns, rel.fetchall())
