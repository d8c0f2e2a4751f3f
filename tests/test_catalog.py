"""Every query with SQL must give its rows, on the smallest tables."""

import duckdb
import pytest

from adaptlm.plans import rounds  # noqa: F401
from adaptlm.plans.catalog import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == columns
    rows = [tuple(map(repr, r)) for r in want.select(*(f'"{c}"' for c in columns)).fetchall()]
    assert sorted(tuple(map(repr, r)) for r in df.select(*columns).collect()) == sorted(rows)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
