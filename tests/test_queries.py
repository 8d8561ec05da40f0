"""Every registered query against its SQL at the smallest size."""

import math

import duckdb
import pytest

from courierlens.plans import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, FOLDER)
    got = df.collect()
    if name in ORACLE_SQL:
        found = oracle.sql(ORACLE_SQL[name])
        assert sorted(found.columns) == sorted(df.columns)
        order = [df.columns.index(c) for c in found.columns]
        key = lambda rows: sorted((tuple(plain(v) for v in r) for r in rows), key=repr)
        assert key([[r[i] for i in order] for r in got]) == key(found.fetchall())
