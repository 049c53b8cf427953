"""Every query with SQL gives the same rows as DuckDB on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from resonant.plans.catalogue import ORACLE_SQL, QUERIES
from tests.conftest import DATA


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    ran = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in ran.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in ran.fetchall()), key=repr)
    assert sorted(df.columns) == sorted(names)
    assert got == want


def test_every_query_has_rows_and_names():
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert "entry_series_profile" in QUERIES
