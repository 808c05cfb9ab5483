"""Nearest neighbours beside brute force, and the whole set of stated queries."""

import numpy as np

from termloom import queries as Q
from termloom.operators import retrieve
from termloom.operators.vector_index import VectorIndex

DIR = "/root/testdata/sf0.01"


def brute(vectors, wanted, k):
    out = []
    for q in wanted:
        x = np.array(vectors[q][0], float)
        found = [(round(float(x @ y / np.sqrt((x @ x) * (y @ y))), 6), i, lab) for i, (y, lab) in ((i, (np.array(v, float), lab)) for i, (v, lab) in vectors.items()) if i != q]
        out += [(q, i, lab, c, p + 1) for p, (c, i, lab) in enumerate(sorted(found, key=lambda f: (-f[0], f[1]))[:k])]
    return out


def test_stated_queries_are_all_searched(spark):
    vectors = {r.vec_id: (r.embedding, r.label) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()}
    want = brute(vectors, sorted(i for i in vectors if i % 20 == 0), 5)
    got = sorted((r.query_id, r.vec_id, r.label, r.cosine, r.place) for r in Q.QUERIES["knn_topk"](spark, DIR).collect())
    assert len(want) == 5 * 25 and got == sorted(want, key=lambda w: (w[0], w[1]))
    rate = Q.QUERIES["knn_label_hit_rate"](spark, DIR).first()
    assert rate.n == len(want) and rate.hit_rate == round(sum(vectors[q][1] == lab for q, _, lab, _, _ in want) / len(want), 6)


def test_nearest_over_blocks(spark):
    rng = np.random.default_rng(3)
    vectors = {i: (rng.integers(-2, 3, 4).tolist(), f"l{i % 3}") for i in range(2500)}
    vectors = {i: (v if any(v) else [1, 0, 0, 0], lab) for i, (v, lab) in vectors.items()}
    v = spark.createDataFrame([(i, [float(x) for x in v], lab) for i, (v, lab) in vectors.items()], "vec_id bigint, vec array<float>, label string").coalesce(1)
    found = retrieve.nearest(v.where("vec_id % 4 = 0").selectExpr("vec_id AS query_id", "vec"), v, 7)
    got = sorted((r.query_id, r.place, r.vec_id, r.label, r.cosine) for r in found.collect())
    assert got == sorted((q, p, i, lab, c) for q, i, lab, c, p in brute(vectors, range(0, 2500, 4), 7))


def test_nearest_without_direction(spark):
    rows = [(1, [1.0, 0.0], 1), (2, None, 2), (3, [0.0, 0.0], 3), (4, [2.0, 1.0], None), (5, [1.0], 5), (6, [float("nan"), 1.0], 6), (None, [1.0, 0.0], 7)]
    v = spark.createDataFrame(rows, "vec_id bigint, vec array<float>, label int")
    got = retrieve.nearest(v.where("vec_id IN (1, 2)").selectExpr("vec_id AS query_id", "vec"), v, 3).collect()
    assert sorted((r.query_id, r.place, r.vec_id, r.label, r.cosine) for r in got) == [(1, 1, 4, None, 0.894427), (1, 2, 2, 2, None), (1, 3, 3, 3, None), (2, 1, 1, 1, None), (2, 2, 3, 3, None), (2, 3, 4, None, None)]


def test_index_is_exact_skips_clusters_and_is_read_again(spark, tmp_path):
    rng = np.random.default_rng(8)
    hubs = rng.normal(size=(40, 6))
    x = np.concatenate([hubs[rng.integers(0, 40, 3000)] + 0.02 * rng.normal(size=(3000, 6)), np.repeat(hubs[:1], 1500, axis=0)])  # one cluster holds a third
    rows = [(("a", "b", "c")[i % 3], i, i % 7, [float(c) for c in v]) for i, v in enumerate(x)] + [("a", 9000, 1, None), ("b", 9001, 2, [1e300] * 6), (None, 9002, 3, [0.5] * 6)]
    v = spark.createDataFrame(rows, "key string, vec_id bigint, label int, vec array<double>").repartition(3)
    built = VectorIndex.build(v, str(tmp_path / "index"), clusters=30)
    held = {i: (vec, lab, key or "") for key, i, lab, vec in rows if vec}

    def loop(wanted, k):
        out = []
        for q, key in wanted:
            found = []
            for i, (y, lab, own) in held.items():
                if i != q and key in (None, own):
                    a, b = (np.array(z) / np.abs(z).max() for z in (held[q][0], y))
                    found.append((-round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 6), i, lab))
            out += [(q, i, lab, -c, p + 1) for p, (c, i, lab) in enumerate(sorted(found)[:k])]
        return out

    wanted = [(i, None if i % 2 else held[i][2]) for i in range(0, 4500, 300)] + [(7, None), (8, "c")]
    for index in (built, VectorIndex(spark, str(tmp_path / "index"))):  # the second reads what is stored
        queries = spark.createDataFrame([(q, key, held[q][0]) for q, key in wanted], "query_id bigint, key string, vec array<double>")
        got = sorted((r.query_id, r.place, r.vec_id, r.label, r.cosine) for r in index.search(queries, 6).collect())
        assert got == sorted((q, p, i, lab, c) for q, i, lab, c, p in loop(wanted, 6))
    assert built.skipped(queries, 6) > 0.7
    assert "CartesianProduct" not in built.search(queries, 6)._jdf.queryExecution().toString()


def test_memory_of_placing_rows_does_not_grow_with_centres(spark):
    import tracemalloc

    import pyarrow as pa

    from termloom.operators import vector_index

    x = np.random.default_rng(5).normal(size=(8000, 16))
    peaks = []
    for n in (32, 1024):
        got = vector_index.assigned(Batches(x), {16: vector_index.unit(x[:n])})
        tracemalloc.start()
        out = pa.Table.from_batches(list(got))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        far = vector_index.distances(vector_index.unit(x), vector_index.unit(x[:n]))
        assert (out["cluster"].to_numpy() == far.argmin(1)).all() and np.allclose(out["away"].to_numpy(), far.min(1), atol=1e-6)
    assert peaks[1] < 3 * peaks[0] and peaks[1] < 40e6, peaks


class Batches:
    """Rows that run a task's function here, over one batch of all of them."""

    def __init__(self, x):
        import pyarrow as pa
        from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

        self.schema = StructType([StructField("vec", ArrayType(DoubleType()))])
        self.batch = pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64()))], ["vec"])

    def mapInArrow(self, run, schema):
        return run(iter([self.batch]))
