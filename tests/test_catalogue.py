"""Every catalogue query against its SQL in DuckDB."""

import datetime
import decimal

import duckdb
import pytest

from quarry.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 6)
    return str(v) if isinstance(v, datetime.date) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name == "gzip_density":  # DuckDB has no gzip; see test_density
        assert len(got) == duck.execute("select count(*) from documents").fetchone()[0]
        return
    cur = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, cur.fetchall()) and got
