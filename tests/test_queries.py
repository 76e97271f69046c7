"""Every query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

from sparkloom.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def same(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 8)
    return v


@pytest.mark.parametrize("name", list(SQL))
def test_sql(spark, duck, sf_dir, name):
    own = QUERIES[name](spark, sf_dir)
    r = duck.execute(SQL[name])
    columns = [c[0] for c in r.description]
    assert sorted(own.columns) == sorted(columns)
    order = sorted(columns)
    theirs = sorted(repr(tuple(same(row[columns.index(c)]) for c in order)) for row in r.fetchall())
    ours = sorted(repr(tuple(same(row[c]) for c in order)) for row in own.collect())
    assert ours == theirs


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
