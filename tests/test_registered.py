from pathlib import Path

import duckdb
import pytest
from __spark_entry__ import entry, oracle_sql, queries

SMALL = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="needs the driver's tables")


def database():
    connection = duckdb.connect()
    for file in SMALL.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def test_every_oracle_belongs_to_a_query_and_runs():
    assert set(oracle_sql()) <= set(queries())
    connection = database()
    for name, sql in oracle_sql().items():
        assert connection.execute(f"EXPLAIN {sql}").fetchall(), name


@pytest.fixture
def compiled(spark):
    """The session with code generation, as queries run outside the tests."""
    settings = {"spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "FALLBACK"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield spark
    for name, value in before.items():
        spark.conf.set(name, value)


# The queries over training data are tested with their own subpackage.
@pytest.mark.parametrize("name", sorted(name for name in oracle_sql() if not name.startswith("op")))
def test_small_tables_agree(compiled, name):
    frame = queries()[name](compiled, str(SMALL))
    columns = sorted(frame.columns)
    ours = sorted(map(repr, map(tuple, frame.select(*columns).collect())))
    theirs = database().execute(f"SELECT {', '.join(columns)} FROM ({oracle_sql()[name]})").fetchall()
    assert ours == sorted(map(repr, theirs)) and ours


def test_entry(spark):
    assert entry(spark).count() == 6
