"""Every registered query against its SQL on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from deckloom.plans import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = registry.queries(), registry.sql()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    if isinstance(v, int):
        return f"{float(v):.6g}" if abs(v) < 1 << 53 else str(v)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v.date() if isinstance(v, datetime.datetime) else v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF_DIR):
        c.execute(f"create view {t.split('.')[0]} as select * from '{SF_DIR}/{t}'")
    return c


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(SQL))
def test_like_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    cols = sorted(df.columns)
    got = sorted(str([plain(x) for x in r]) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(str([plain(r[i]) for i in at]) for r in rel.fetchall())
