"""Every registered query with SQL gives what DuckDB gives on the same tables."""

from pathlib import Path

import duckdb
import pytest

from millrace.plans import registry


def _value(v):
    if v is None or v != v:
        return "null"
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


def _rows(df):
    return sorted(tuple(map(_value, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, db, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    if name in registry.ORACLES:
        want = db.sql(registry.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert _rows(got) == _rows(want)


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(registry.QUERIES) >= 85
