"""Every registered query against its SQL at the smallest scale."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from spanforge import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return made


def plain(value):
    return round(value, 9) if isinstance(value, float) and math.isfinite(value) else value


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, DATA)
    got = sorted(repr(tuple(map(plain, r))) for r in df.select(*sorted(df.columns)).collect())
    if name not in queries.ORACLE_SQL:
        return
    cursor = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert sorted(names) == sorted(df.columns)
    assert got == sorted(repr(tuple(plain(r[k]) for k in order)) for r in cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())
