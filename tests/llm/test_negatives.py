"""Hard negatives beside sorting all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.llm import negatives

LABEL, ANCHOR = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END", "vec_id % 100 = 0"
SCHEMA = "vec_id bigint, embedding array<float>, label int, rank int, id int, `a.b` int"


def table():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 12)).astype(np.float32) * np.linspace(2, 0.1, 12)
    x[::3] += 1
    x[200:260] = x[100]
    data = [(k, [float(np.float32(c)) for c in r], int(rng.integers(0, 4))) for k, r in enumerate(x)]
    data += [(2000, None, 1), (2100, [1.0] * 12, None), (2200, [float("nan")] * 12, 1), (2201, [None] * 12, 1), (2300, [], 2), (2400, [1.0, 2.0], 1), (2401, [1.0, 3.0], 1), (2402, [1.0, 1.5], 2)]
    return data + [(None, [1.0] * 12, 3), (2500, [0.0] * 12, 2), (3, *data[3][1:]), (500, *data[500][1:])]


def brute(data):
    finite = lambda v: v and all(c is not None and np.isfinite(c) for c in v)
    good = [(i, (m + 1) % 10 if i % 7 == 0 else m, np.floor(256 * np.array(v, np.float64))) for i, v, m in data if i is not None and m is not None and finite(v)]
    out = []
    for i, m, x in good:
        if i % 100 == 0:
            scores = [(-int(x @ y), j, k) for j, k, y in good if j != i and len(y) == len(x)]
            for s, j, _ in sorted(t for t in scores if t[2] == m)[:5]:
                band = sorted(t for t in scores if t[2] != m and 30 * -s <= 100 * -t[0] <= 90 * -s)[:10]
                out += [(i, j, r + 1, t[1], -s, -t[0]) for r, t in enumerate(band)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"rows": 64, "query_rows": 5, "slab_bytes": 2000}])
def test_against_all_pairs(spark, sizes):
    data = table()
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in data], SCHEMA).repartition(3)
    got = negatives.mined(df, is_anchor=F.expr(ANCHOR), label=F.expr(LABEL), **sizes).collect()
    assert sorted(tuple(r) for r in got) == brute(data)


def test_nothing_to_mine(spark):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in table()], SCHEMA)
    assert negatives.mined(df.limit(0), is_anchor=F.expr(ANCHOR), label=F.expr(LABEL)).count() == 0
    assert negatives.mined(df.where("vec_id = 7"), is_anchor=F.expr(ANCHOR), label=F.expr(LABEL)).count() == 0
    assert negatives.mined(df.where("vec_id IN (100, 101)"), is_anchor=F.expr(ANCHOR), label=F.lit(1)).count() == 0


def test_bounds_never_lose_a_pair():
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.normal(size=(300, 16)) * np.linspace(1, 0.05, 16))
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    s = x @ x.T
    floor, high = np.quantile(s, 0.9, axis=1), np.quantile(s, 0.99, axis=1)
    alive = negatives.survivors(x @ axes, x @ axes, np.ones(s.shape, bool), floor, high, 1e-12)
    inside = (s >= floor[:, None]) & (s <= high[:, None])
    assert not (inside & ~alive).any() and alive.mean() < 0.5


@pytest.mark.parametrize("dense", [0.0, 1.0])
def test_products_either_way(monkeypatch, dense):
    monkeypatch.setattr(negatives, "DENSE", dense)
    x = np.arange(40.0).reshape(5, 8)
    i, j, s = negatives.products(x, x, np.eye(5, dtype=bool))
    assert s.tolist() == [int(x[k] @ x[k]) for k in range(5)] and i.tolist() == j.tolist()
