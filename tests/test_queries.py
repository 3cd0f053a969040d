"""Every registered query of the library against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from tessera.plans.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "~"
        return repr(v + 0.0) if isinstance(v, float) else str(v)

    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    found = QUERIES[name](spark, DATA)
    data = [tuple(r) for r in found.collect()]
    if name not in ORACLES:
        assert data
        return
    want = duck.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(want.columns)
    assert rows(found.columns, data) == rows(want.columns, want.fetchall())
