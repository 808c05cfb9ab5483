"""A stored index of vectors for exact nearest neighbours by cosine, searched by the triangle inequality.

Rows lie in Parquet, partitioned by vocabulary and cluster, packed into blocks. A cell (a vocabulary's part of a cluster) knows how far from the cluster's centre
its rows lie, nearest and farthest, as distances of unit vectors. A query at distance q of a centre is at least q - farthest, and nearest - q, away from all rows of a
cell. A search takes two rounds: the cells nearest to a query that hold enough rows give a bound on its k-th neighbour, and the second round
reads every other cell that can hold something within the bound. No cell that is left out can hold a better row, so results are exact however the
centres lie; only cells that some query needs are read, as partitions of the table.

Centres are fitted on a bounded sample (SAMPLE rows; every row is indexed) and there are at most CLUSTERS a length of vectors, so centres and cells are small
enough to travel with tasks; more than CELLS cells are an error. Rows without a direction (null, empty, zero or non-finite vectors) and rows of
another length than a query's have no cosine: they come last, by id.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import blocks
from .store import shared_dir, written

#: Rows that centres are fitted on, most centres a length, most cells, rounds of fitting, cells that a query's first round reads at least.
SAMPLE, CLUSTERS, CELLS, FITS, PROBES = 20_000, 1024, 1_000_000, 5, 2
#: Distances of rows to centres that a task holds at once.
NEAR = 1 << 18
#: What rounding may change of a distance.
SLACK = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fitted(x: np.ndarray, n: int) -> np.ndarray:
    """n centres of unit vectors, by a few rounds of k-means from evenly spread rows."""
    centres = x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)]
    for _ in range(FITS):
        own = np.argmax(x @ centres.T - (centres**2).sum(1) / 2, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        many = np.bincount(own, minlength=len(centres))[:, None]
        centres = np.where(many > 0, sums / np.maximum(many, 1), centres)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Between all rows of both."""
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2 * x @ centres.T, 0))


def nearest_centres(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the nearest centre and the distance to it. Distances are held for NEAR of them at once, however many rows and centres there are."""
    step = max(1, NEAR // len(centres))
    parts = [(far.argmin(1), far.min(1)) for far in (distances(unit(x[a : a + step]), centres) for a in range(0, len(x), step))]
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


class VectorIndex:
    """An index at a path. Its rows: key (a vocabulary), vec_id, label and the vector."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.rows = spark.read.parquet(f"{path}/blocks")
        self.centres = {r.dim: np.array(r.centres) for r in spark.read.parquet(f"{path}/centres").collect()}
        cells = spark.read.parquet(f"{path}/cells").orderBy("dim", "key", "cluster").limit(CELLS + 1).collect()
        if len(cells) > CELLS:
            raise ValueError(f"more than {CELLS} cells; use fewer clusters a vocabulary")
        self.cells = cells

    @staticmethod
    def build(vectors: DataFrame, path: str, clusters: int | None = None) -> VectorIndex:
        """vectors: key (text; null counts as empty), vec_id, label, vec. Rows without an id are left out."""
        spark = vectors.sparkSession
        rows = vectors.where("vec_id IS NOT NULL").select(stored_key("key").alias("key"), "vec_id", "label", blocks.directed("vec").alias("vec"))
        dims = {r.dim: r.n for r in rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).collect()}
        total = sum(n for dim, n in dims.items() if dim)
        share = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(total, 1)) * (1 << 30))
        sample: dict[int, list] = {}
        for r in rows.where(share & (F.size("vec") > 0)).select("vec").limit(2 * SAMPLE).toLocalIterator():
            sample.setdefault(len(r.vec), []).append(r.vec)
        centres = {}
        for dim, n in dims.items():
            if dim:
                some = sample.get(dim) or [r.vec for r in rows.where(F.size("vec") == dim).limit(1).collect()]
                centres[dim] = fitted(unit(np.array(some)), min(clusters or int(n**0.5) + 1, CLUSTERS))
        made = [(dim, c.tolist()) for dim, c in centres.items()]
        spark.createDataFrame(made, "dim int, centres array<array<double>>").coalesce(1).write.parquet(f"{path}/centres")
        placed = assigned(rows, centres).hint("rebalance", "key", "cluster").sortWithinPartitions("key", "dim", "cluster")
        placed_blocks(placed).write.partitionBy("key", "cluster").parquet(f"{path}/blocks")
        stored = spark.read.parquet(f"{path}/blocks")
        cells = stored.groupBy("key", "dim", "cluster").agg(F.sum(F.size("vec_id")).alias("n"), F.min("nearest").alias("nearest"), F.max("farthest").alias("farthest"))
        cells.coalesce(1).write.parquet(f"{path}/cells")
        return VectorIndex(spark, path)

    def search(self, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
        """queries: query_id, key (null for all vocabularies), vec. query_id, vec_id, label, cosine (rounded) and place of the k nearest, without the query's own id."""
        asked = queries.where("query_id IS NOT NULL").select("query_id", F.when(F.col("key").isNotNull(), stored_key("key")).alias("key"), blocks.directed("vec").alias("vec"))
        first = written(self.within(self.planned(asked.withColumn("bound", F.lit(None).cast("double")), k), k, digits))
        bound = F.sqrt(F.greatest(2 - 2 * (F.min("cosine") - 10.0**-digits), F.lit(0.0))) + SLACK
        known = first.groupBy("query_id").agg(F.when(F.count("cosine") >= k, bound).otherwise(F.lit(float("inf"))).alias("bound"))
        again = asked.join(known, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        second = self.within(self.planned(again, k), k, digits)
        found = best(first.unionByName(second), k).where("cosine IS NOT NULL").drop("place")
        return best(found.unionByName(self.rest(asked, found, k)), k)

    def planned(self, asked: DataFrame, k: int) -> DataFrame:
        """Blocks of queries for every cell that they have to visit: those of the first round where bound is null, else what the bound adds to these. visits and
        cells count what is searched, of how much."""
        centres, cells = self.centres, self.cells
        by_dim: dict[int, tuple] = {}
        for dim in centres:
            own = [c for c in cells if c.dim == dim]
            by_dim[dim] = ([c.key for c in own], *[np.array([c[f] for c in own], kind) for f, kind in (("cluster", int), ("n", int), ("nearest", float), ("farthest", float))])
        id_type = to_arrow_type(asked.schema["query_id"].dataType)
        fields = [("key", pa.string()), ("cluster", pa.int32()), ("q_query_id", pa.list_(id_type)), ("q_dim", pa.int32()), ("q_vecs", pa.binary()), ("visits", pa.int64()), ("cells", pa.int64())]
        schema = pa.schema(fields)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, wanted, bounds = (batch.column(n) for n in ("query_id", "key", "bound"))
                sizes = np.diff(batch.column("vec").offsets.to_numpy())
                for dim in (d for d in np.unique(sizes) if d in by_dim):
                    keys, cluster, n, nearest, farthest = by_dim[dim]
                    names = np.array(keys, object)
                    for a in range(0, int((sizes == dim).sum()), blocks.QUERY_ROWS):
                        at = np.flatnonzero(sizes == dim)[a : a + blocks.QUERY_ROWS]
                        raw = batch.column("vec").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                        to_centre = distances(unit(raw), centres[dim])[:, cluster]
                        least = np.maximum(np.maximum(to_centre - farthest, nearest - to_centre), 0) - SLACK
                        visit = np.zeros(least.shape, bool)
                        possible = 0
                        for p, q in enumerate(at):
                            key, bound = wanted[q].as_py(), bounds[q].as_py()
                            may = np.ones(len(n), bool) if key is None else names == key
                            possible += int(may.sum())
                            order = np.flatnonzero(may)[np.argsort(to_centre[p, may], kind="stable")]
                            # the query's own row is no neighbour: one more
                            enough = max(PROBES, int(np.searchsorted(np.cumsum(n[order]), k + 1)) + 1)
                            visit[p, order[:enough]] = True
                            if bound is not None:
                                visit[p] = may & ~visit[p] & (least[p] <= bound)
                        for c in np.flatnonzero(visit.any(0)):
                            some = np.flatnonzero(visit[:, c])
                            own = ids.take(pa.array(at[some]))
                            row = [pa.array([keys[c]]), pa.array([cluster[c]], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), own), pa.array([dim], pa.int32())]
                            row += [pa.array([raw[some].astype("<f8").tobytes()], pa.binary()), pa.array([len(some)], pa.int64()), pa.array([possible], pa.int64())]
                            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(row, schema, strict=True)], schema=schema)
                            possible = 0

        kind = asked.schema["query_id"].dataType.simpleString()
        return asked.mapInArrow(run, f"key string, cluster int, q_query_id array<{kind}>, q_dim int, q_vecs binary, visits bigint, cells bigint")

    def within(self, plan: DataFrame, k: int, digits: int) -> DataFrame:
        """The k nearest of each query among the rows of the cells that it visits; other cells' partitions aren't read."""
        plan = written(plan)
        needed = [(r.key, r.cluster) for r in plan.select("key", "cluster").distinct().collect()]  # at most CELLS
        rows = self.rows.where(F.col("key").isin([x for x, _ in needed]) & F.col("cluster").isin([c for _, c in needed]))
        rows = rows.select("key", "cluster", F.col("dim").alias("q_dim"), F.col("dim").alias("c_dim"), F.col("vec_id").alias("c_vec_id"), F.col("label").alias("c_label"), F.col("vecs").alias("c_vecs"))
        met = plan.drop("visits", "cells").join(rows, ["key", "cluster", "q_dim"])
        return best(blocks.closest(met, k, digits), k).drop("place")

    def skipped(self, queries: DataFrame, k: int, digits: int = 6) -> float:
        """The share of pairs of queries and cells that a search needn't visit."""
        asked = queries.select("query_id", F.when(F.col("key").isNotNull(), stored_key("key")).alias("key"), blocks.directed("vec").alias("vec"))
        plan = written(self.planned(asked.withColumn("bound", F.lit(None).cast("double")), k))
        first = self.within(plan, k, digits).groupBy("query_id").agg(F.min("cosine").alias("c"), F.count("cosine").alias("n"))
        bound = F.when(F.col("n") >= k, F.sqrt(F.greatest(2 - 2 * (F.col("c") - 10.0**-digits), F.lit(0.0))) + SLACK).otherwise(F.lit(float("inf")))
        again = self.planned(asked.join(first, "query_id").withColumn("bound", bound).drop("c", "n"), k)
        done = plan.agg(F.sum("visits").alias("v"), F.sum("cells").alias("c")).first()
        return 1 - (done.v + (again.agg(F.sum("visits")).first()[0] or 0)) / done.c

    def rest(self, asked: DataFrame, found: DataFrame, k: int) -> DataFrame:
        """For queries with fewer than k neighbours that have a cosine: the rows of other lengths or without a direction, by id."""
        each = self.rows.select("dim", F.explode(F.arrays_zip("vec_id", "label")).alias("r")).select("dim", "r.vec_id", "r.label")
        dims = sorted({c.dim for c in self.cells})
        few = [each.where(F.col("dim") == d).orderBy("vec_id").limit(k + 1) for d in dims]  # k + 1 rows a length
        lacking = asked.join(found.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < k)
        lacking = lacking.where("key IS NULL").select("query_id", F.size("vec").alias("own"))
        if not few:
            return found.limit(0)
        others = few[0]
        for more in few[1:]:
            others = others.unionByName(more)
        met = lacking.join(F.broadcast(others), (F.col("own") == 0) | (F.col("own") != F.col("dim")))
        return met.where(F.col("query_id") != F.col("vec_id")).select("query_id", "vec_id", "label", F.lit(None).cast("double").alias("cosine"))


def stored_key(key: str) -> Column:
    """As partitions are named: a letter first, so that an empty one is kept and none is taken for a number."""
    return F.concat(F.lit("v"), F.coalesce(F.col(key).cast("string"), F.lit("")))


def best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("cosine"), "vec_id")
    return rows.select("query_id", "vec_id", "label", "cosine").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def assigned(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """rows with dim, the nearest cluster and the distance to its centre; cluster -1 without a direction."""
    names = [f.name for f in rows.schema.fields]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column("vec")
            sizes = np.diff(vec.offsets.to_numpy())
            cluster, away = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            for dim in np.unique(sizes[sizes > 0]):
                at = np.flatnonzero(sizes == dim)
                cluster[at], away[at] = nearest_centres(vec.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), centres[dim])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes.astype(np.int32)), pa.array(cluster), pa.array(away)], [*names, "dim", "cluster", "away"])

    return rows.mapInArrow(run, f"{types}, dim int, cluster int, away double")


def placed_blocks(rows: DataFrame) -> DataFrame:
    """Rows in order of key, dim and cluster, packed: key, cluster, dim, vec_id and label (arrays), vecs, nearest and farthest."""
    kinds = {n: rows.schema[n].dataType for n in ("vec_id", "label")}
    lists = {n: pa.list_(to_arrow_type(t)) for n, t in kinds.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [batch.column(n).to_pylist() for n in ("key", "dim", "cluster")]
            keys = list(zip(*same, strict=True))
            away, a = batch.column("away").to_numpy(), 0
            while a < len(keys):
                b = a + 1
                while b < len(keys) and keys[b] == keys[a] and b - a < blocks.ROWS:
                    b += 1
                part = batch.slice(a, b - a)
                vecs = part.column("vec").flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes()
                ids = [pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), pa.concat_arrays([part.column(n)])).cast(lists[n]) for n in ("vec_id", "label")]
                key, dim, cluster = keys[a]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key]), pa.array([cluster], pa.int32()), pa.array([dim], pa.int32()), *ids, pa.array([vecs], pa.binary()), pa.array([away[a:b].min()]), pa.array([away[a:b].max()])],
                    ["key", "cluster", "dim", "vec_id", "label", "vecs", "nearest", "farthest"],
                )
                a = b

    schema = f"key string, cluster int, dim int, vec_id array<{kinds['vec_id'].simpleString()}>, label array<{kinds['label'].simpleString()}>, vecs binary, nearest double, farthest double"
    return rows.mapInArrow(run, schema)


def new_path(spark: SparkSession) -> str:
    """A place for an index that ends with the session, in the folder of spark.checkpoint.dir."""
    return f"{shared_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
