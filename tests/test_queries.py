"""Every registered query against its SQL, over whole tables at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as contract
from ledgerloom.plans import catalog, oracles

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
ALL_QUERIES, ALL_ORACLES = contract.queries(), contract.oracle_sql()
#: The queries of the section engine; the others have tests of their own.
QUERIES = {name: ALL_QUERIES[name] for name in catalog.QUERIES}
ORACLES = {name: ALL_ORACLES[name] for name in oracles.ORACLES}


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(f"{type(r[i]).__name__}:{r[i]}" for i in order) for r in rows)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(ALL_ORACLES) <= set(ALL_QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    frame = QUERIES[name](spark, sf_dir)
    expected = duck.sql(ORACLES[name])
    assert sorted(frame.columns) == sorted(expected.columns)
    got = normal(frame.columns, frame.collect())
    assert got == normal(expected.columns, expected.fetchall())


def test_entry_runs(spark):
    assert contract.entry(spark).count() == 200


def test_rows_of_a_small_table_are_dealt_over_all_cores(spark, sf_dir):
    """A table of few bytes is one task's scan; what is made of its rows is not."""
    assert contract.queries()["B4_toc_table_item"](spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
