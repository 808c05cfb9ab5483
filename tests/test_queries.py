"""Every core query beside its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from termloom import queries as Q
from termloom import reports  # noqa: F401  registers its queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int | float):
        return f"{float(v):.5g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, DIR)
    cursor = duck.execute(Q.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted(tuple(plain(dict(zip(columns, r, strict=True))[c]) for c in sorted(columns)) for r in cursor.fetchall())
    got = sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect())
    assert got == want
