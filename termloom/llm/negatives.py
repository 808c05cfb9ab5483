"""Hard negatives: for anchors, the best rows of their own label, and for each of these the best rows of other labels within a band of its score.

Scores are inner products of whole numbers. Vectors are rotated onto the principal axes of the whole table (an orthogonal matrix, so inner products stay what they are but
for rounding), and partial products over leading components are accumulated. What the remaining components can add lies within the product of
the two residual norms, so a candidate whose partial product plus that bound (and a slack for rounding) stays below what a query has already is
discarded early, and so is one that lies above its band for certain. What survives is verified by the product of the whole numbers.

Candidates stay where they lie; query blocks come to them in slabs of a bounded number of bytes, which is why a slab may be broadcast, one slab after
another. A task keeps the best of each query over all blocks it reads, so it sends at most k rows a query; those of all tasks are ranked at the end. A label is
a mask on scores and no key, so a label with a third of the rows is no hot key.

Rows without an id or a label, and vectors that are null, empty or hold null or non-finite components, take no part. Rows of the query's id are not
its candidates, nor are vectors of another length. Ties go to the smaller id. Repeated rows count each: a repeated anchor is mined once a row, and repeated candidates take a rank each. An empty table, or one
without anchors, gives an empty result. Only the id, the vector, the label and the columns of is_anchor are read; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import packed, rows_of, unpacked, usable
from .common import freed, stored

#: Rows of a query block and of a candidate block, candidates scored at once, bytes of the query blocks that are broadcast at once.
QUERY_ROWS, ROWS, PART, SLAB_BYTES = 1024, 4096, 1024, 32 << 20
#: Shares of the components after which bounds are tested; the part of pairs from which products are made of all pairs at once.
STEPS, DENSE = (0.5, 0.75, 0.875), 0.05
LOWEST, HIGHEST = -(1 << 62), 1 << 62


def rotations(blocks: DataFrame) -> dict[int, tuple[np.ndarray, float]]:
    """For each length of vectors: the orthogonal matrix of principal axes, largest first, and the part of two norms' product that rounding may change.

    One matrix of second moments a task and length is all that reaches the driver; its size depends on the length only."""

    def moments(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for row in rows_of(rows):
            _, x = unpacked(row["ids"], row["vecs"], row["dim"], row["kind"])
            largest = max(float(np.abs(x).max()), 1.0)
            x = x / largest  # only directions matter
            sums[row["dim"]] = sums.get(row["dim"], 0) + x.T @ x
        for dim, m in sums.items():
            yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "m": pa.array([m.tolist()], pa.list_(pa.list_(pa.float64())))})

    each = blocks.mapInArrow(moments, "dim int, m array<array<double>>")
    cell = each.select("dim", F.posexplode("m").alias("i", "row")).select("dim", "i", F.posexplode("row").alias("j", "x"))
    out: dict[int, tuple[np.ndarray, float]] = {}
    for r in cell.groupBy("dim", "i", "j").agg(F.sum("x").alias("x")).groupBy("dim").agg(F.collect_list(F.struct("i", "j", "x")).alias("cells")).toLocalIterator():
        m = np.zeros((r.dim, r.dim))
        for i, j, x in r.cells:
            m[i, j] = x
        axes = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1]
        defect = np.abs(axes.T @ axes - np.eye(r.dim)).sum(1).max()
        out[r.dim] = np.ascontiguousarray(axes), float(2 * defect + 16 * r.dim * np.finfo(float).eps)
    return out


class Best:
    """The best k of each query so far: scores and ids, and what a score must reach and may not exceed to matter."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.scores, self.ids = np.full((len(low), k), LOWEST), np.full((len(low), k), HIGHEST)

    def floor(self) -> np.ndarray:
        return np.maximum(self.low, self.scores[:, -1])

    def take(self, i: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of queries i join their best; ties go to the smaller id."""
        rows = np.unique(i)
        if not len(rows):
            return
        at = np.r_[np.repeat(rows, self.k), i]
        s, d = np.r_[self.scores[rows].ravel(), scores], np.r_[self.ids[rows].ravel(), ids]
        order = np.lexsort((d, -s, at))
        start = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0])
        first = order[start[:, None] + np.arange(self.k)]
        self.scores[rows], self.ids[rows] = s[first], d[first]


def survivors(y: np.ndarray, z: np.ndarray, alive: np.ndarray, floor: np.ndarray, high: np.ndarray, slack: float) -> np.ndarray:
    """Which pairs of rotated queries y and candidates z can have a product from floor to high, of those alive."""
    dim = y.shape[1]
    size = slack * np.outer(np.linalg.norm(y, axis=1), np.linalg.norm(z, axis=1))
    partial, done = 0.0, 0
    for share in STEPS:
        upto = int(dim * share)
        if upto == done or not alive.any():
            continue
        partial = partial + y[:, done:upto] @ z[:, done:upto].T
        rest = np.outer(np.linalg.norm(y[:, upto:], axis=1), np.linalg.norm(z[:, upto:], axis=1)) * (1 + slack) + size
        alive = alive & (partial + rest >= floor[:, None]) & (partial - rest <= high[:, None])
        done = upto
    return alive


def products(x: np.ndarray, c: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs that are alive, and their inner products as whole numbers."""
    i, j = np.nonzero(alive)
    if len(i) > DENSE * alive.size:
        s = (x @ c.T)[i, j]
    else:
        s = np.concatenate([np.zeros(0), *(np.einsum("nd,nd->n", x[i[a : a + 65536]], c[j[a : a + 65536]]) for a in range(0, len(i), 65536))])
    return i, j, np.rint(s).astype(np.int64)


def best_in_band(queries: DataFrame, candidates: DataFrame, k: int, same: bool, axes: dict, slab_bytes: int, query_rows: int) -> DataFrame:
    """number, rank, id and score: for every query (number, id, label, low, high, vec) the k highest scores from low to high among candidates (blocks with labels) of
    the same label, or of other labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, Best]] = {}
        for row in rows_of(batches):
            turn, slack = axes[row["dim"]]
            q, x = unpacked(row["ids"], row["vecs"], row["dim"], row["kind"])
            label, number, low, high = (np.frombuffer(row[n], "<i8") for n in ("label", "number", "low", "high"))
            _, best = held.setdefault(row["b"], (number, Best(low, high, k)))
            ids, c = unpacked(row["c_ids"], row["c_vecs"], row["dim"], row["c_kind"])
            labels = np.frombuffer(row["c_label"], "<i8")
            y, z = x @ turn, c @ turn
            for a in range(0, len(ids), PART):
                part = slice(a, a + PART)
                alive = ((label[:, None] == labels[None, part]) == same) & (q[:, None] != ids[None, part])
                alive = survivors(y, z[part], alive, best.floor(), high, slack)
                i, j, s = products(x, c[part], alive)
                good = (s >= best.floor()[i]) & (s <= high[i])
                best.take(i[good], s[good], ids[part][j[good]])
        for number, best in held.values():
            i, at = np.nonzero(best.scores > LOWEST)
            yield pa.RecordBatch.from_pydict({"number": number[i], "id": best.ids[i, at], "score": best.scores[i, at]})

    blocks = slabbed(packed(queries.select("id", "label", "number", "low", "high", "vec"), [], query_rows, ("label", "number", "low", "high")), slab_bytes)
    last = blocks.agg(F.max("slab")).first()[0]
    found = []
    beside = candidates.select("dim", *[F.col(c).alias(f"c_{c}") for c in ("kind", "ids", "label", "vecs")])
    for slab in range(0 if last is None else last + 1):
        met = beside.join(F.broadcast(blocks.where(F.col("slab") == slab)), "dim")
        found.append(stored(met.mapInArrow(run, "number bigint, id bigint, score bigint")))
    freed(blocks)
    schema = "number bigint, id bigint, score bigint"
    spark = queries.sparkSession
    rows = spark.read.parquet(*[f.stored_path for f in found]) if found else spark.createDataFrame([], schema)
    best = Window.partitionBy("number").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def slabbed(blocks: DataFrame, slab_bytes: int) -> DataFrame:
    """Stored blocks with a number b, and slab: as many as make about slab_bytes share one."""
    blocks = stored(blocks.withColumn("b", F.monotonically_increasing_id()))
    sizes = blocks.select("b", (F.length("vecs") + 5 * F.length("ids")).cast("bigint").alias("bytes"))
    before = F.sum("bytes").over(Window.orderBy("b")) - F.col("bytes")  # over numbers of blocks only
    out = stored(blocks.join(sizes.select("b", F.floor(before / F.lit(slab_bytes)).cast("int").alias("slab")), "b"))
    freed(blocks)
    return out


def mined(
    vectors: DataFrame, *, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", rows: int = ROWS, query_rows: int = QUERY_ROWS, slab_bytes: int = SLAB_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score.

    label: a column expression of whole numbers. A component x counts as floor(scale * x), x as double; products are exact while their sums stay below 2**53. A
    negative's score lies from least to most hundredths of the positive's.
    """
    spark = vectors.sparkSession
    whole = lambda x: F.floor(x.cast("double") * scale).cast("double")
    good = vectors.where(usable(vector_col) & F.col(id_col).isNotNull() & label.isNotNull())
    good = good.select(F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"), F.transform(vector_col, whole).alias("vec"))
    blocks = stored(packed(good.select("id", "label", "vec"), [], rows, ("label",)).repartition(spark.sparkContext.defaultParallelism * 3))
    axes = rotations(blocks)
    anchors = stored(good.where("is_anchor").select("id", "label", "vec").withColumn("number", F.monotonically_increasing_id()))
    parts = max(1, -(-anchors.count() // query_rows))
    unbounded = [F.lit(LOWEST).alias("low"), F.lit(HIGHEST).alias("high")]
    first = best_in_band(anchors.select("*", *unbounded).repartition(parts), blocks, positives, True, axes, slab_bytes, query_rows)
    first = stored(first.select(F.col("number").alias("anchor"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # from ceil(least * p / 100) to floor(most * p / 100), in whole numbers
    p = F.col("positive_score")
    down = lambda x: F.expr(f"(({x}) - pmod({x}, 100)) div 100")
    band = first.join(anchors.withColumnRenamed("number", "anchor"), "anchor").select(
        "anchor", "positive_id", "positive_score", "id", "label", "vec", (-down(f"-{least} * positive_score")).alias("low"), down(f"{most} * positive_score").alias("high"),
    ).where("low <= high")
    asked = stored(band.withColumn("number", F.monotonically_increasing_id()))
    parts = max(1, -(-asked.count() // query_rows))
    second = best_in_band(asked.repartition(parts), blocks, negatives, False, axes, slab_bytes, query_rows)
    mine = second.select("number", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = asked.select("number", F.col("id").alias("anchor_id"), "positive_id", p).join(mine, "number")
    out = stored(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    freed(blocks, anchors, first, asked)
    return out
