"""Registered queries against DuckDB over the smallest tables; several run side by side, as each only reads the tables."""

import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from millrace import queries

SF = "/root/testdata/sf0.001"
#: Names to compare, all by default.
SOME = os.environ.get("QUERIES", "").split()


def plain(rows):
    return sorted((tuple(round(float(x), 4) if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.fixture(scope="module")
def results(spark):
    """Columns and rows of every query, or what it raised."""

    def run(name):
        try:
            got = queries.Q[name](spark, SF)
            order = sorted(got.columns)
            return order, plain(got.select(*order).collect())
        except Exception as e:  # shown by the query's own test
            return e

    names = SOME or sorted(queries.SQL)
    with ThreadPoolExecutor(4) as pool:
        return dict(zip(names, pool.map(run, names)))


@pytest.mark.parametrize("name", SOME or sorted(queries.SQL))
def test_query(results, name):
    if isinstance(results[name], Exception):
        raise results[name]
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    order, rows = results[name]
    want = con.sql(queries.SQL[name])
    assert order == sorted(want.columns)
    assert rows == plain(want.select(*order).fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
