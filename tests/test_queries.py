"""Every registered query of the engine against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from tideline import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return con


def plain(x):
    return tuple(plain(v) for v in x) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(repr(plain(tuple(r))) for r in df.select(names).collect())
    if name not in catalog.ORACLES:
        assert got
        return
    out = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in out.description]
    assert sorted(columns) == names
    order = sorted(range(len(columns)), key=columns.__getitem__)
    assert got == sorted(repr(plain(tuple(r[i] for i in order))) for r in out.fetchall())
