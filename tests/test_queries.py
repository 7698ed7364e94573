"""Every registered query against its SQL twin on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return v if isinstance(v, (bool, int)) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    res = con.execute(ORACLE[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == columns
    want = [[norm(r[names.index(c)]) for c in columns] for r in res.fetchall()]
    got = [[norm(r[c]) for c in columns] for r in df.collect()]
    order = lambda r: [(v is None, str(v)) for v in r]
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=order), sorted(want, key=order)):
        for a, b in zip(g, w):
            assert a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-5))


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def test_names():
    assert set(ORACLE) <= set(QUERIES)
