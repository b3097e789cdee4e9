"""Columns come in the order of the SQL's, so that rows can be compared by their places."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["payload_typed", "clock_unpack", "word_encode", "time_units"])
def test_columns_are_in_the_order_of_the_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF}/events.parquet')")
    assert entry.queries()[name](spark, SF).columns == [c[0] for c in db.execute(f"DESCRIBE {entry.oracle_sql()[name]}").fetchall()]
