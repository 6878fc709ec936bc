"""Every query with SQL gives the SQL's rows on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.oracle_sql() if n.startswith("r")))
def test_query(spark, con, name):
    out = __spark_entry__.queries()[name](spark, DIR)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(out.columns)
    assert columns == sorted(want.columns)
    place = [list(want.columns).index(c) for c in columns]
    got = sorted(repr(tuple(plain(r.asDict(True)[c]) for c in columns)) for r in out.collect())
    assert got == sorted(repr(tuple(plain(row[i]) for i in place)) for row in want.fetchall())
