"""Every registered core query with SQL against DuckDB on the smallest tables, and the recall of the one without."""

import math
import os

import duckdb
import pytest

from lodestack.plans import oracles, registry
from tests.conftest import SMALL

QUERIES, SQL = registry.queries(), oracles.oracle_sql()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for file in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SMALL}/{file}'")
    return con


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(row[c]) for c in columns) for row in df.collect()), key=str)
    answer = duck.execute(SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    theirs = sorted((tuple(plain(row[i]) for i in places) for row in answer.fetchall()), key=str)
    assert ours == theirs


def test_only_the_approximate_search_has_no_sql():
    assert set(QUERIES) - set(SQL) == {"ann_lsh"}


def test_approximate_search_finds_the_exact_neighbours(spark):
    where = SMALL.replace("0.001", "0.01")
    rows = lambda name: {(r["qid"], r["vec_id"]): r["score"] for r in QUERIES[name](spark, where).collect()}
    exact, near = rows("dense_knn_batch"), rows("ann_lsh")
    shared = exact.keys() & near.keys()
    assert len(shared) >= 0.9 * len(exact)
    assert all(abs(exact[pair] - near[pair]) < 1e-5 for pair in shared)
