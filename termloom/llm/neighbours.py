"""Embedding near-dedup by an epsilon grid order join.

Vectors are scaled to length 1, so a cosine is a distance. They are sorted by the cells of a grid, as wide as the greatest distance of a link,
over their leading principal dimensions (from a bounded sample), and the sequence is cut into blocks. Projections never lie further apart than vectors, so
two blocks whose boxes of projections are too far apart hold no link and are never joined. Other pairs of blocks are joined recursively: intervals are
halved, provably distant ones skipped, and small ones compared by a product of matrices in double precision.

Equal vectors are one representative with a number of copies, so a vector with very many copies costs nothing. What a pair of
blocks sends is a row a representative: how many vectors it links to, and the root of its links in this pair; no pairs.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing. Vectors of unlike lengths don't link.
Rows without an id are returned with no links. Rows of one id count as several vectors. A cosine that ties with the threshold
is a link. An empty table gives an empty result; columns other than the id and the vector are not read, and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .blocks import packed, rows_of, unpacked, usable
from .common import freed, hash_sample, stored
from .graph import components

#: Rows of a block and of the smallest intervals; dimensions of the grid and of the boxes; vectors that the principal dimensions come from.
ROWS, LEAF, GRID, BOX, SAMPLE = 8192, 256, 4, 16, 4_000
#: Blocks of a cell that one task holds against the cell's others.
MEETING = 64


def leading(sample: np.ndarray) -> np.ndarray:
    """The principal dimensions of unit vectors, as columns of an orthonormal matrix."""
    x = sample - sample.mean(0)
    _, vectors = np.linalg.eigh(x.T @ x)
    return vectors[:, ::-1][:, :BOX].copy()


def apart(a: np.ndarray, b: np.ndarray) -> float:
    """The least square distance of the boxes around two sets of points."""
    gap = np.maximum(0, np.maximum(a.min(0) - b.max(0), b.min(0) - a.max(0)))
    return float(gap @ gap)


def leaves(pa_: np.ndarray, pb: np.ndarray, a: tuple[int, int], b: tuple[int, int], far: float, same: bool) -> Iterator[tuple[tuple[int, int], tuple[int, int]]]:
    """Pairs of intervals, of at most LEAF rows each, that may hold links. same: both are of one sequence, each pair once."""
    if apart(pa_[a[0] : a[1]], pb[b[0] : b[1]]) > far:
        return
    na, nb = a[1] - a[0], b[1] - b[0]
    if max(na, nb) <= LEAF:
        yield a, b
    elif same and a == b:
        m = (a[0] + a[1]) // 2
        for x, y in (((a[0], m), (a[0], m)), ((a[0], m), (m, a[1])), ((m, a[1]), (m, a[1]))):
            yield from leaves(pa_, pb, x, y, far, same)
    elif na >= nb:
        m = (a[0] + a[1]) // 2
        yield from leaves(pa_, pb, (a[0], m), b, far, same)
        yield from leaves(pa_, pb, (m, a[1]), b, far, same)
    else:
        m = (b[0] + b[1]) // 2
        yield from leaves(pa_, pb, a, (b[0], m), far, same)
        yield from leaves(pa_, pb, a, (m, b[1]), far, same)


def settle(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Gives all that the links i-j connect the least root among them."""
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, before[i], low)
        np.minimum.at(root, before[j], low)
        root[:] = root[root]
        while True:
            step = root[root]
            if (step == root).all():
                break
            root[:] = step
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]


def linked(vectors: DataFrame, threshold: float = 0.95, *, id_col: str = "vec_id", vector_col: str = "embedding", rows: int = ROWS) -> DataFrame:
    """Per row of vectors: the id, n_links long, component_id long (the smallest id reachable, itself included) and kept."""
    all_ = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("raw"))
    good = usable("raw") & F.exists("raw", lambda x: x != 0) & F.col("id").isNotNull()
    # floats stay floats; 0.0 for -0.0, so that equal vectors are equal as keys
    kind = "float" if all_.schema["raw"].dataType.elementType == FloatType() else "double"
    valid = all_.where(good).select("id", F.transform("raw", lambda x: x.cast(kind) + F.lit(0.0).cast(kind)).alias("vec"))
    reps = stored(valid.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    found = _pairs(reps, threshold, rows)
    sums = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.where("root <> id").select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    reps = reps.join(sums, "id", "left").join(joined, "id", "left").select("vec", links.alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = valid.join(reps, "vec").select("id", "n_links", "component_id")
    rest = all_.where(~F.coalesce(good, F.lit(False))).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(rest).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pairs(reps: DataFrame, threshold: float, rows: int) -> DataFrame:
    """Stored rows id, links, root: a row a representative and pair of blocks with a link in it."""
    spark = reps.sparkSession
    far = 2 - 2 * threshold + 1e-9  # the greatest square distance of a link
    width = far**0.5
    per = reps.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n"))
    dims = per.agg(F.max_by("d", F.struct("n", -F.col("d"))).alias("d"), F.sum("n").alias("all")).first()
    if dims.d is None:
        return spark.createDataFrame([], "id bigint, links bigint, root bigint")
    dim = dims.d  # vectors of other lengths lie at the origin of the grid
    some = hash_sample(reps.where(F.size("vec") == dim).select("id", "vec"), "id", SAMPLE).collect()
    axes = leading(unit(np.array([r.vec for r in sorted(some, key=lambda r: r.id)], np.float64)))

    def project(x: np.ndarray) -> np.ndarray:
        return x @ axes if x.shape[1] == dim else np.zeros((len(x), axes.shape[1]))

    ordered = _in_order(reps, project, dim, width).repartitionByRange(max(1, round(dims.all / rows)), "cell", "first", "id")
    # as many parts as blocks, so that a block's size doesn't depend on the cluster's
    ordered = ordered.sortWithinPartitions("cell", "first", "id").select("id", "copies", "vec")
    blocks = _boxed(packed(ordered, [], rows, ("copies",)), project)
    near = _near(blocks, far, width)
    data = lambda k: blocks.select(*[F.col(c).alias(f"{c}{k}") for c in ("b", "kind", "ids", "copies", "vecs")], *([F.col("dim")] if k == 1 else []))
    # a block meets itself without being sent twice
    near = near.withColumn("other", F.when(F.col("b1") != F.col("b2"), F.col("b2"))).drop("b2")
    pairs = near.join(data(1), "b1").join(data(2), F.col("other") == F.col("b2"), "left").drop("other")
    out = stored(pairs.mapInArrow(lambda batches: _links(batches, project, threshold, far), "id bigint, links bigint, root bigint"))
    freed(blocks)
    return out


def _in_order(reps: DataFrame, project, dim: int, width: float) -> DataFrame:
    """reps with cell, their place in the grid, and first, that on the leading dimension."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = project(np.zeros((0, dim)))
            p = np.zeros((batch.num_rows, p.shape[1]))
            length = np.diff(batch.column(2).offsets.to_numpy())
            at = np.flatnonzero(length == dim)
            if len(at):
                flat = batch.column(2).filter(pa.array(length == dim)).flatten().to_numpy(zero_copy_only=False)
                p[at] = project(unit(flat.astype(np.float64).reshape(-1, dim)))
            cell = np.floor(p / width).astype(np.int32)
            order = pa.array(list(cell[:, :GRID]), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, order, pa.array(p[:, 0])], ["id", "copies", "vec", "cell", "first"])

    kind = reps.schema["vec"].dataType.simpleString()
    return reps.select("id", "copies", "vec").mapInArrow(cells, f"id bigint, copies bigint, vec {kind}, cell array<int>, first double")


def _boxed(blocks: DataFrame, project) -> DataFrame:
    """Stored blocks with a number b, and lo and hi, the corners of the box around their projections."""

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            p = project(unit(unpacked(r["ids"], r["vecs"], r["dim"], r["kind"])[1]))
            yield pa.RecordBatch.from_pydict({"dim": pa.array([r["dim"]], pa.int32()), **{c: [r[c]] for c in ("kind", "ids", "copies", "vecs")}, "lo": [p.min(0).tolist()], "hi": [p.max(0).tolist()]})

    out = blocks.mapInArrow(boxes, "dim int, kind string, ids binary, copies binary, vecs binary, lo array<double>, hi array<double>")
    return stored(out.withColumn("b", F.monotonically_increasing_id()))


def _near(blocks: DataFrame, far: float, width: float) -> DataFrame:
    """Pairs b1 <= b2 of blocks whose boxes are near enough. Blocks meet in the cells of the leading dimension that they reach (a pair
    counts in the first that it shares); of a cell's blocks one task holds a part against all."""
    corners = blocks.select("b", "dim", "lo", "hi")
    parts = max(1, round((corners.count() / MEETING) ** 0.5))
    cell = lambda x: F.floor(x / width).cast("int")
    reach = F.explode(F.sequence(cell(F.col("lo")[0]), cell(F.col("hi")[0]) + 1)).alias("cell")
    named = lambda k, *more: corners.select(F.col("b").alias(f"b{k}"), "dim", F.col("lo").alias(f"lo{k}"), F.col("hi").alias(f"hi{k}"), *more)
    one = named(1, reach, F.pmod(F.xxhash64("b"), F.lit(parts)).alias("part"))
    two = named(2, reach).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
    gap = F.zip_with(F.zip_with("lo1", "hi2", lambda x, y: x - y), F.zip_with("lo2", "hi1", lambda x, y: x - y), lambda x, y: F.greatest(F.lit(0.0), x, y))
    first_shared = F.col("cell") == F.greatest(cell(F.col("lo1")[0]), cell(F.col("lo2")[0]))
    near = one.join(two, ["dim", "cell", "part"]).where((F.col("b1") <= F.col("b2")) & first_shared)
    near = near.where(F.aggregate(gap, F.lit(0.0), lambda a, x: a + x * x) <= far).select("b1", "b2")
    return near.repartition(blocks.sparkSession.sparkContext.defaultParallelism * 4, "b1", "b2")


def _links(batches: Iterator[pa.RecordBatch], project, threshold: float, far: float) -> Iterator[pa.RecordBatch]:
    """Of each pair of blocks (without a second one: of a block with itself) the ids with links, how many, and their roots."""
    for r in rows_of(batches):
        same = r["ids2"] is None
        sides = []
        for s in (1,) if same else (1, 2):
            ids, x = unpacked(r[f"ids{s}"], r[f"vecs{s}"], r["dim"], r[f"kind{s}"])
            norm = np.linalg.norm(x, axis=1)
            sides.append((ids, x / norm[:, None], np.frombuffer(r[f"copies{s}"], "<i8"), x, norm))
        (i1, u1, c1, x1, n1), (i2, u2, c2, x2, n2) = sides[0], sides[-1]
        ids = i1 if same else np.concatenate([i1, i2])
        links, shift = np.zeros(len(ids), np.int64), 0 if same else len(i1)
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))  # roots are places in the order of ids
        root = np.arange(len(ids))
        for a, b in leaves(project(u1), project(u2), (0, len(i1)), (0, len(i2)), far, same):
            g = u1[a[0] : a[1]] @ u2[b[0] : b[1]].T
            hit = g >= threshold
            for i, j in zip(*np.nonzero(np.abs(g - threshold) < 1e-12), strict=True):
                hit[i, j] = x1[a[0] + i] @ x2[b[0] + j] / (n1[a[0] + i] * n2[b[0] + j]) >= threshold
            if same and a == b:
                np.fill_diagonal(hit, False)
            if not hit.any():
                continue
            links[a[0] : a[1]] += hit @ c2[b[0] : b[1]]
            if not (same and a == b):
                links[shift + b[0] : shift + b[1]] += c1[a[0] : a[1]] @ hit
            i, j = np.nonzero(hit)
            settle(root, place[i + a[0]], place[j + shift + b[0]])
        at = np.flatnonzero(links)
        yield pa.RecordBatch.from_pydict({"id": ids[at], "links": links[at], "root": ids[order[root[place[at]]]]})
