"""The queries of the training-data operators that have SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from lodestack.llm import queries
from tests.conftest import SMALL

QUERIES, SQL = queries.queries(), queries.oracle_sql()


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SMALL}/{file}'")
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    ours = sorted((tuple(row[c] for c in columns) for row in df.collect()), key=str)
    answer = con.execute(SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(row[names.index(c)] for c in columns) for row in answer.fetchall()), key=str)
    assert ours == theirs
