"""Every registered core query against its SQL on the small tables."""

import math
import os

import duckdb
import pytest

from weftlens.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def text(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "~"
    return f"{x:.6f}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = sorted(tuple(map(text, r)) for r in df.select(*columns).collect())
    answer = tables.execute(registry.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    expected = sorted(tuple(text(r[names.index(c)]) for c in columns) for r in answer.fetchall())
    assert found == expected
