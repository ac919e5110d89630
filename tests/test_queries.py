"""Every query against its SQL counterpart, on the smallest data."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from commitloom.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings commits bugs changes change_details blobs raw_lines eval_items mix_targets".split()


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    if v is None or isinstance(v, (bool, int)):
        return v
    return round(float(v), 5) if hasattr(v, "as_tuple") else str(v)


def rows(cols, values):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_like_sql(spark, data, sql, name):
    df = QUERIES[name](spark, data)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = sql.execute(ORACLE[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert got == rows(cols, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() >= 0


def test_entry(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() > 0
