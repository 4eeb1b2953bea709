"""Every registered query with SQL, against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from corpusgraph.plans import registered

QUERIES, ORACLES = registered()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return float(f"{v:.6g}")
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    got = rows(df.columns, [tuple(r.asDict(recursive=True).values()) for r in df.collect()])
    assert len(got) > 0 and got == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_others_run(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
