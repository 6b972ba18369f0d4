"""Every query against its SQL on the smallest tables, in one shared session."""

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def norm(v):
    return float(v) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    mine = sorted((tuple(norm(r[c]) for c in order) for r in rows), key=key)
    theirs = sorted((tuple(norm(r[names.index(c)]) for c in order) for r in cur.fetchall()), key=key)
    assert mine == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0
