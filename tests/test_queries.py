"""Every registered query against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for file in SF_DIR.glob("*.parquet"):
        connection.execute(f"create view {file.stem} as select * from '{file}'")
    return connection


def test_every_query_has_sql():
    assert set(entry.QUERIES) == set(entry.ORACLE_SQL)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 200


@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_query_equals_sql(spark, database, name):
    table = entry.queries()[name](spark, str(SF_DIR))
    columns = sorted(table.columns)
    result = database.execute(entry.oracle_sql()[name])
    names = [column[0] for column in result.description]
    assert sorted(names) == columns
    order = [names.index(column) for column in columns]
    expected = sorted(repr(tuple(row[at] for at in order)) for row in result.fetchall())
    assert sorted(repr(tuple(row[column] for column in columns)) for row in table.collect()) == expected
