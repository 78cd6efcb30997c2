"""Every registered query against its SQL twin on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from inkveil.checks import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def test_every_query_has_a_twin():
    assert catalog.QUERIES.keys() == catalog.ORACLES.keys()
    assert catalog.QUERIES.keys() <= contract.queries().keys()


def test_entry(spark):
    assert contract.entry(spark).columns == ["entity_type", "n"]


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, db, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted(tuple(map(repr, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    result = db.execute(catalog.ORACLES[name])
    order = [d[0] for d in result.description]
    assert sorted(order) == columns
    theirs = sorted(tuple(repr(r[order.index(c)]) for c in columns) for r in result.fetchall())
    assert ours == theirs
