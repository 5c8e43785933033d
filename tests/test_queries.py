"""Every query with SQL against DuckDB at the smallest scale; the others for rows."""

import datetime
import math
import os

import pytest

from tidemark.queries import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(D):
        con.sql(f"create view {f.split('.')[0]} as select * from '{D}/{f}'")
    return con


def plain(v):
    if isinstance(v, datetime.datetime) and (v.hour, v.minute, v.second, v.microsecond) == (0, 0, 0, 0):
        return v.date()
    if isinstance(v, float) and not math.isnan(v):
        assert v != 0 or math.copysign(1, v) > 0
    return None if isinstance(v, float) and math.isnan(v) else v


def ordered(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, D), duck.sql(ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert ordered(got.select(*cols).collect()) == ordered(want.select(*(f'"{c}"' for c in cols)).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - {"detect_hotspots", "two_expert_classifier"}))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, D).count() > 0
