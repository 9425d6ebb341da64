"""Queries against DuckDB at sf0.001."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from kindred.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", [n for n in QUERIES])
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(_plain(v) for _, v in sorted(zip(names, r))) for r in got.fetchall())
    assert Counter(tuple(_plain(r[c]) for c in sorted(names)) for r in df.collect()) == want
