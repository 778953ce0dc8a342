"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import datetime
from pathlib import Path

import duckdb
import pytest

from millrace.plans import ORACLES, QUERIES

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


def rows(table):
    def plain(v):
        if isinstance(v, datetime.datetime):
            return v.replace(tzinfo=None).isoformat()
        return repr(round(v, 9)) if isinstance(v, float) else str(v)

    names = sorted(table.column_names)
    return names, sorted(tuple(plain(r[n]) for n in names) for r in table.to_pylist())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in SF.iterdir():
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    want = duck.sql(ORACLES[name])
    assert rows(QUERIES[name](spark, str(SF)).toArrow()) == rows(want.to_arrow_table())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(SF)).count() > 0
