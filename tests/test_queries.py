"""Every registered query with SQL gives the rows of its SQL on the small tables."""

import math
from pathlib import Path

import duckdb
import pytest

from skyloom import registry

DATA = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    ours, theirs = registry.queries()[name](spark, DATA), duck.sql(SQL[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    key = lambda rows: sorted((tuple(plain(v) for v in r) for r in rows), key=str)
    assert key(ours.select(*columns).collect()) == key(theirs.select(*columns).fetchall())


def test_queries_without_sql_have_rows(spark):
    for name in set(registry.queries()) - set(SQL):
        assert registry.queries()[name](spark, DATA).count() > 0
