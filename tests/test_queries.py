"""Every registered query against its SQL, on the smallest given tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_file
from tests.conftest import rows

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")

SQL = entry_file.oracle_sql()
# The optional package's queries have tests of their own.
QUERIES = {n: q for n, q in entry_file.queries().items() if not n.startswith("op") and n != "pipeline"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def test_every_query_has_its_sql():
    assert set(QUERIES) <= set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, str(DATA))
    found = duck.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    want = [tuple(r[columns.index(c)] for c in order) for r in found.fetchall()]
    assert rows(got, *order) == sorted(want, key=repr)


def test_entry(spark):
    assert entry_file.entry(spark).count() == 3
