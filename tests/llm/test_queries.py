"""Every query of the subpackage that SQL can express beside it, on the smallest tables."""

import math

import duckdb
import pytest

from termloom.llm import queries as Q

DIR = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    return f"{float(v):.6g}" if isinstance(v, int | float) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    cursor = con.execute(Q.ORACLES[name])
    columns = sorted(c[0] for c in cursor.description)
    at = {c[0]: k for k, c in enumerate(cursor.description)}
    want = sorted(tuple(plain(r[at[c]]) for c in columns) for r in cursor.fetchall())
    df = Q.QUERIES[name](spark, DIR)
    assert sorted(df.columns) == columns
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


LEADING = {
    "op1_quality": ["doc_id", "held_out", "score", "predicted"],
    "op3_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op5_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op6_urls": ["page_id", "host", "path", "rule", "verdict"],
    "op7_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
}


@pytest.mark.parametrize("name", sorted(LEADING))
def test_leading_columns(spark, name):
    df = Q.QUERIES[name](spark, DIR)
    assert df.columns[: len(LEADING[name])] == LEADING[name]
    table = "pages" if name == "op6_urls" else "documents"
    assert df.count() == spark.read.parquet(f"{DIR}/{table}.parquet").count()
