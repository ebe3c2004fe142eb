"""Every registered relational query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from rillbase import queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(value):
    if value is None or value != value:
        return "none"
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


def test_every_query_has_an_oracle():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_oracle(spark, duck, name):
    found = queries.QUERIES[name](spark, FOLDER)
    told = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in told.description]
    assert sorted(found.columns) == sorted(names)
    order = sorted(names)
    ours = sorted(tuple(plain(row[c]) for c in order) for row in found.collect())
    theirs = sorted(tuple(plain(row[names.index(c)]) for c in order) for row in told.fetchall())
    assert ours == theirs
