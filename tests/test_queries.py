"""Every named query against its SQL counterpart, over whole tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from chronolog.plans.queries import QUERIES
from chronolog.plans.reference_sql import SQL

FOLDER = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for table in FOLDER.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    return connection


def test_every_query_of_the_library_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.skipif(not FOLDER.exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query_equals_sql(spark, sql, name):
    df = entry.queries()[name](spark, str(FOLDER))
    names = sorted(df.columns)
    got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
    cursor = sql.execute(entry.oracle_sql()[name])
    order = [d[0] for d in cursor.description]
    assert sorted(order) == names
    expected = sorted((tuple(r[order.index(n)] for n in names) for r in cursor.fetchall()), key=repr)
    assert got == expected
