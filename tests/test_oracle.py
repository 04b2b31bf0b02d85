"""Every registered query against SQL on the same tables: names, types and values."""

import pytest

import __spark_entry__ as entry
from aspectra.plans.oracle import ORACLE
from aspectra.plans.queries import QUERIES
from compare import open_tables, spark_rows, sql_rows

SQL = ORACLE
NO_SQL = {"compound_best_path", "iterative_fold"}

# Spark type -> SQL type.
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def tables(sf):
    return open_tables(sf)


def test_every_query_has_sql():
    assert set(QUERIES) - set(SQL) == NO_SQL
    assert set(SQL) <= set(QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, tables, name):
    df = QUERIES[name](spark, sf)
    described = {r[0]: r[1] for r in tables.execute(f"DESCRIBE {SQL[name]}").fetchall()}
    assert {c: TYPES[t] for c, t in df.dtypes} == described
    got, expected = spark_rows(df), sql_rows(tables, SQL[name])
    assert got[0] == expected[0]
    assert len(got[1]) > 0
    assert got[1] == expected[1]


def test_entry(spark):
    assert entry.entry(spark).count() == 6
