"""Exact top-k search by distributed histogram selection.

Queries and candidates are packed into blocks. Candidates stay where they lie; query blocks come to them in slabs, each of a bounded
number of bytes, which is why a slab may be broadcast; there are as many slabs, one after another, as the queries need. Scores are whole numbers.
A first pass makes a coarse histogram of each query's scores, a second one refines the bin that holds its k-th score, and so on until
bins are single scores: then the k-th score is known exactly. A last pass keeps the scores above it and, of those equal to it, the
smallest ids. A candidate block sends the bins from its own k-th score up only, since no lower one can hold the k-th of all, and
a task adds up its blocks' bins: a few rows a query and task, whatever the number of candidates.

Vectors that are null, empty or hold null or non-finite components take no part. Vectors of another length than a query's are no candidates of it.
A query's own row (its id) is no candidate; a query with fewer than k candidates gets all. Ties go to the smaller id. Equal rows of one id each count.
Rows without an id take no part. An empty table, or one without queries, gives an empty result; columns other than the id, the vector and those of
is_query are not read, and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import packed, rows_of, unpacked, usable
from .common import freed, stored

#: Rows of a query block and of a candidate block, bins of a histogram, and bytes of the query blocks that are broadcast at once.
QUERY_ROWS, ROWS, BINS, SLAB_BYTES = 2048, 4096, 1024, 32 << 20
#: Queries scored at once, and what stands for a query's product with itself.
PART, OWN = 256, -(1 << 62)


def meeting(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """Every candidate block beside every query block of a slab."""
    named = candidates.select(F.col("dim").alias("c_dim"), F.col("kind").alias("c_kind"), F.col("ids").alias("c_ids"), F.col("vecs").alias("c_vecs"))
    return named.join(F.broadcast(queries), F.col("dim") == F.col("c_dim"))


def scored(row: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every PART queries of a joined row: the place of the first, the candidates' ids in order, and the inner products
    as whole numbers; a query's own row has a product below all others."""
    q, x = unpacked(row["ids"], row["vecs"], row["dim"], row["kind"])
    c, y = unpacked(row["c_ids"], row["c_vecs"], row["dim"], row["c_kind"])
    order = np.argsort(c, kind="stable")
    c, y = c[order], y[order]
    for a in range(0, len(q), PART):
        s = np.rint(x[a : a + PART] @ y.T).astype(np.int64)
        s[q[a : a + PART, None] == c[None, :]] = OWN
        yield a, c, s


def histograms(joined: DataFrame, k: int, span: int, width: int, bins: int) -> DataFrame:
    """q, place, bin, n: for each query, the bins of its range from a candidate block's own k-th score up, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            base, above = np.frombuffer(row["base"], "<i8"), np.frombuffer(row["above"], "<i8")
            for a, _, s in scored(row):
                low, need = base[a : a + len(s)], k - above[a : a + len(s)]
                s -= low[:, None]
                at = np.where(s >= span, bins, np.maximum(s // width, -1)) + 1  # 0: below the range; bins + 1: above it, counted before
                at += np.arange(len(s))[:, None] * (bins + 2)
                n = np.bincount(at.ravel(), minlength=len(s) * (bins + 2)).reshape(len(s), -1)[:, 1:-1]
                higher = n[:, ::-1].cumsum(1)[:, ::-1] - n
                i, b = np.nonzero((n > 0) & (higher < need[:, None]))
                yield pa.RecordBatch.from_pydict({"q": np.full(len(i), row["q"], np.int32), "place": (i + a).astype(np.int32), "bin": b.astype(np.int32), "n": n[i, b].astype(np.int64)})

    return joined.mapInArrow(run, "q int, place int, bin int, n bigint")


def winners(joined: DataFrame, k: int) -> DataFrame:
    """q, place, query_id, id, score: scores above the k-th, and of those equal to it the smallest ids of each candidate block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            q = np.frombuffer(row["ids"], "<i8")
            base, above = np.frombuffer(row["base"], "<i8"), np.frombuffer(row["above"], "<i8")
            for a, c, s in scored(row):
                v, rest = base[a : a + len(s), None], k - above[a : a + len(s), None]
                tie = s == v
                i, j = np.nonzero(((s > v) & (s > OWN)) | (tie & (tie.cumsum(1) <= rest)))
                yield pa.RecordBatch.from_pydict({"q": np.full(len(i), row["q"], np.int32), "place": (i + a).astype(np.int32), "query_id": q[i + a], "id": c[j], "score": s[i, j]})

    return joined.mapInArrow(run, "q int, place int, query_id bigint, id bigint, score bigint")


def top_k(
    vectors: DataFrame, k: int, *, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding",
    rows: int = ROWS, query_rows: int = QUERY_ROWS, bins: int = BINS, scale: int = 64, slab_bytes: int = SLAB_BYTES,
) -> DataFrame:
    """query_id, rank (from 1), the candidate's id and score for every row that is_query holds for. A component x counts
    as floor(scale * x), x as double; products are exact while their sums stay below 2**53."""
    spark = vectors.sparkSession
    whole = lambda x: F.floor(x.cast("double") * scale).cast("double")
    good = vectors.where(usable(vector_col) & F.col(id_col).isNotNull())
    asks = F.coalesce(is_query, F.lit(False)).alias("is_query")
    good = good.select(F.col(id_col).cast("bigint").alias("id"), asks, F.transform(vector_col, whole).alias("vec"))
    candidates = stored(packed(good, [], rows).repartition(spark.sparkContext.defaultParallelism * 3))
    reach = candidates.select(F.max("largest").alias("m")).first().m
    asked = stored(good.where("is_query").select("id", "vec"))
    queries = slabbed(packed(asked.repartition(max(1, -(-asked.count() // query_rows))), [], query_rows), slab_bytes)
    freed(asked)
    found = []
    last = queries.agg(F.max("slab")).first()[0]
    for slab in range(0 if last is None else last + 1):
        found.append(stored(_best(queries.where(F.col("slab") == slab).drop("slab"), candidates, k, int(reach**2) + 1, bins)))
    freed(candidates, queries)
    if not found:
        return spark.createDataFrame([], f"query_id bigint, rank int, {id_col} bigint, score bigint")
    return spark.read.parquet(*[f.stored_path for f in found]).select("query_id", "rank", F.col("id").alias(id_col), "score")


def slabbed(blocks: DataFrame, slab_bytes: int) -> DataFrame:
    """Stored blocks with a number q each, and slab: as many blocks as make about slab_bytes share one."""
    blocks = stored(blocks.withColumn("b", F.monotonically_increasing_id()))
    order = Window.orderBy("b")  # over numbers of blocks only
    before = F.sum("bytes").over(order) - F.col("bytes")
    sizes = blocks.select("b", (F.length("vecs") + 3 * F.length("ids")).cast("bigint").alias("bytes"))  # ids, base and above are of one size
    numbers = sizes.select("b", (F.row_number().over(order) - 1).alias("q"), F.floor(before / F.lit(slab_bytes)).cast("int").alias("slab"))
    out = stored(blocks.join(numbers, "b").select("q", "slab", "dim", "kind", "ids", "vecs"))
    freed(blocks)
    return out


def _best(queries: DataFrame, candidates: DataFrame, k: int, reach: int, bins: int) -> DataFrame:
    """query_id, rank, id and score of a slab's queries; no score lies beyond reach (by Cauchy and Schwarz)."""
    n_queries = F.expr("cast(length(ids) div 8 as int)")
    base, above = [F.array_repeat(F.lit(x).cast("bigint"), n_queries) for x in (-reach, 0)]
    state = queries.select("q", F.posexplode(F.arrays_zip(base.alias("base"), above.alias("above"))).alias("place", "s")).select("q", "place", "s.base", "s.above")
    span = 2 * reach + 1
    while span > 1:
        width = -(-span // bins)
        found = histograms(meeting(candidates, with_state(queries, state)), k, span, width, bins).groupBy("q", "place", "bin").agg(F.sum("n").alias("n"))
        from_top = Window.partitionBy("q", "place").orderBy(F.desc("bin"))
        found = found.withColumn("up_to", F.sum("n").over(from_top)).join(state, ["q", "place"])
        hit = found.where((F.col("above") + F.col("up_to") >= k) & (F.col("above") + F.col("up_to") - F.col("n") < k))
        hit = hit.select("q", "place", (F.col("base") + F.col("bin") * width).alias("new_base"), (F.col("above") + F.col("up_to") - F.col("n")).alias("new_above"))
        # a query with fewer than k candidates takes all: its limit stays at the lowest
        base, above = F.coalesce("new_base", F.lit(-reach - 1)), F.coalesce("new_above", "above")
        last, state = state, stored(state.join(hit, ["q", "place"], "left").select("q", "place", base.alias("base"), above.alias("above")))
        freed(last)
        span = width
    best = Window.partitionBy("q", "place").orderBy(F.desc("score"), "id")
    return winners(meeting(candidates, with_state(queries, state)), k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def with_state(queries: DataFrame, state: DataFrame) -> DataFrame:
    """Query blocks with the limits of their queries, packed in order; a block's are as few as its queries."""
    per = state.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("place", "base", "above"))).alias("s"))

    @F.pandas_udf("binary")
    def pack(x: pd.Series) -> pd.Series:
        return x.map(lambda v: np.array(v, "<i8").tobytes())

    return queries.join(per, "q").select("q", "dim", "kind", "ids", "vecs", pack(F.col("s.base")).alias("base"), pack(F.col("s.above")).alias("above"))
