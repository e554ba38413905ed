"""Every query against its SQL on the smallest tables."""

import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from tallyspark import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}")
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    return v.isoformat() if isinstance(v, date) else v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = duck.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    want = rows(names, got.fetchall())
    have = rows(df.columns, [tuple(r) for r in df.collect()])
    assert have == want, (list((have - want).items())[:3], list((want - have).items())[:3])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).collect() is not None
