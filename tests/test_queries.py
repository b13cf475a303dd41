"""Every query with an SQL twin gives the twin's rows on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from compare import difference

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not there")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, database, name):
    run = entry.queries()[name]
    assert difference(run(spark, FOLDER), database.sql(entry.oracle_sql()[name])) is None


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
