"""Every registered query beside its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from stratalens.plans import queries as plans


def text(v):
    return "null" if v is None or v != v else repr(v) if isinstance(v, float) else str(v)


@pytest.fixture(scope="session")
def duck(smallest):
    c = duckdb.connect()
    for p in glob.glob(f"{smallest}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, smallest, duck, name):
    df = plans.QUERIES[name](spark, smallest)
    cols = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
    if name not in plans.SQL:
        assert got
        return
    cur = duck.execute(plans.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(text(r[i]) for i in at) for r in cur.fetchall())


def test_round_trips_verify(spark, smallest):
    assert plans.QUERIES["patch_round_trip"](spark, smallest).where("not verified").count() == 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
