"""Every registered query of the core against its SQL in DuckDB, on the smallest tables."""

import datetime
import glob
import math
import os

import pytest

import __spark_entry__ as entry
from skein import queries as core
from skein.plans import registry

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(core.QUERIES | registry.QUERIES)
#: Queries that SQL does not say, and that find nothing in tables as small as these.
MAY_BE_EMPTY = {"cnx_flows", "nav_completion"}


def plain(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if type(v).__name__ == "Decimal":
        return repr(float(v))
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW \"{os.path.basename(p)[:-8]}\" AS SELECT * FROM '{p}'")
    return con


def check(spark, duck, name, may_be_empty=MAY_BE_EMPTY):
    """The query's rows are those of its SQL; without SQL there are some."""
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    rows = sorted(tuple(plain(v) for v in r) for r in df.select(*cols).collect())
    sql = entry.oracle_sql().get(name)
    if sql:
        got = duck.execute(sql)
        names = [c[0] for c in got.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert rows == sorted(tuple(plain(r[i]) for i in at) for r in got.fetchall())
    else:
        assert rows or name in may_be_empty


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    check(spark, duck, name)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
