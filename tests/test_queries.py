"""Every query against its SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.cleaning.oracle_sql()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def key(row):
    return tuple((x is not None, str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, db, name):
    got = entry.queries()[name](spark, SF)
    want = db.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = sorted((key([r[c] for c in columns]) for r in got.collect()))
    at = [want.columns.index(c) for c in columns]
    b = sorted(key([r[i] for i in at]) for r in want.fetchall())
    assert a == b
    assert a or name == "cfd_detect_clean"


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() == 1500 and out.where("repaired").count() == 841
