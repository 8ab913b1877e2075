"""Every registered query against its SQL twin on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from lodeworks.plans import registry
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.5f}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(tuple(map(cell, r)) for r in zip(*(table.column(n).to_pylist() for n in names), strict=True))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SMALL).toArrow()) == rows(duck.sql(ORACLE[name]).to_arrow_table())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() >= 0


@pytest.mark.parametrize("name", ["weighted_rrf_anchored", "cross_query_rrf_merge", "series_gap_overlap", "manifest_version"])
def test_input_order_does_not_matter(spark, name, monkeypatch):
    from lodeworks.plans import analytics, retrieval
    from lodeworks.session import table as read

    expected = rows(QUERIES[name](spark, SMALL).toArrow())
    for parts in (1, 7):
        shuffled = lambda s, d, t, n=parts: read(s, d, t).repartition(n)
        for module in (analytics, retrieval):
            monkeypatch.setattr(module, "table", shuffled)
        assert rows(QUERIES[name](spark, SMALL).toArrow()) == expected
