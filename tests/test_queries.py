"""Every registered query runs; those with SQL agree with it."""

import os

import pytest

import __spark_entry__ as entry_point
from tests.conftest import rows

QUERIES, ORACLE = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return c


def _plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list):
        return str([_plain(x) for x in v])
    return "null" if v is None or v != v else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    if name not in ORACLE:
        assert df.count() > 0
        return
    got = duck.sql(ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(got.columns)
    expected = [[_plain(v) for v in r] for r in got.select(*[f'"{c}"' for c in columns]).fetchall()]
    found = [[_plain(v) for v in r] for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    assert sorted(found) == sorted(expected)


def test_entry(spark, sf_dir):
    assert rows(entry_point.entry(spark).limit(1))
