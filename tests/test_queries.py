"""Every registered query with SQL against DuckDB, at the smallest scale."""

import math

import duckdb
import pytest

from logloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def comparable(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "~"
        return f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(one(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(name, spark, sf, duck):
    got = registry.QUERIES[name](spark, sf)
    sql = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in sql.description]
    assert sorted(names) == sorted(got.columns)
    assert comparable(got.collect(), got.columns) == comparable(sql.fetchall(), names)
