"""Every query of the catalogue against its SQL in DuckDB, over whole tables."""

import math

import duckdb
import pytest

from flowloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 8)
    return v


def test_all_queries_with_sql_are_registered():
    assert set(SQL) <= set(QUERIES) and len(SQL) >= 100


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=str)
    if name not in SQL:
        assert got
        return
    found = duck.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[k]) for k in places) for r in found.fetchall()), key=str)
