"""Every registered query with SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, str | bool):
        return v
    return round(v, 9) if isinstance(v, float) and not math.isnan(v) else str(v) if isinstance(v, float) else v


def canonical(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, db, name):
    df = entry.queries()[name](spark, SF_DIR)
    names = sorted(df.columns)
    ours = canonical(df.select(*names).collect())
    found = db.execute(entry.oracle_sql()[name])
    theirs_names = [c[0] for c in found.description]
    assert sorted(theirs_names) == names
    at = [theirs_names.index(n) for n in names]
    theirs = canonical([r[i] for i in at] for r in found.fetchall())
    assert ours == theirs
    assert ours


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
