"""Blocks of vectors: many rows of a table packed into one, so that pairs of blocks are joined instead of pairs of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Whether a vector is neither null nor empty and all its components are finite."""
    v = F.col(vector)
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def narrowed(x: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest of three kinds that holds them exactly."""
    for kind in ("<i2", "<f4"):
        with np.errstate(invalid="ignore", over="ignore"):
            small = x.astype(kind)
        if (small == x).all():
            return small
    return x.astype("<f8")


def packed(df: DataFrame, keys: list[str], most: int, more: tuple[str, ...] = ()) -> DataFrame:
    """df: keys, id, more (whole numbers) and vec (array of double or float). Packs each partition's rows of equal keys, in the
    partition's order, into rows of at most `most` vectors: keys, n, dim, kind (of the vectors' numbers), ids and more
    (little-endian 64-bit binaries), vecs (binary) and largest, their greatest norm. Vectors of unlike lengths never share a row."""
    n_keys = len(keys)
    kinds = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)
    names = [*keys, "n", "dim", "kind", "ids", *more, "vecs", "largest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, numbers, vecs = None, [], []

        def out() -> pa.RecordBatch:
            x = np.concatenate(vecs).reshape(len(numbers), -1)
            small = narrowed(x)
            whole = [np.array(c, "<i8").tobytes() for c in zip(*numbers, strict=True)]
            row = [*now[:-1], len(numbers), now[-1], small.dtype.str, *whole, small.tobytes(), float(np.linalg.norm(x.astype(np.float64), axis=1).max())]
            types = [*[batch.schema.field(k).type for k in keys], pa.int32(), pa.int32(), pa.string(), *[pa.binary()] * (len(more) + 2), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        for batch in batches:
            last = batch.column(batch.num_columns - 1)
            values, offsets = last.flatten().to_numpy(zero_copy_only=False), last.offsets.to_numpy()
            offsets = offsets - offsets[0]
            columns = [c.to_pylist() for c in batch.columns[:-1]]
            for k in range(batch.num_rows):
                a, b = offsets[k], offsets[k + 1]
                key = (*[c[k] for c in columns[:n_keys]], int(b - a))
                if numbers and (key != now or len(numbers) >= most):
                    yield out()
                    numbers, vecs = [], []
                now = key
                numbers.append([c[k] for c in columns[n_keys:]])
                vecs.append(values[a:b])
        if numbers:
            yield out()

    schema = f"{kinds}n int, dim int, kind string, ids binary, {''.join(f'{c} binary, ' for c in more)}vecs binary, largest double"
    return df.select(*keys, "id", *more, "vec").mapInArrow(run, schema)


def unpacked(ids: bytes, vecs: bytes, dim: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids, and the vectors in double precision."""
    return np.frombuffer(ids, "<i8"), np.frombuffer(vecs, kind).astype(np.float64).reshape(-1, dim)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of batches of blocks, one at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: c[k].as_py() for name, c in zip(batch.schema.names, batch.columns, strict=True)}
