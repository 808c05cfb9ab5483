"""Blocks of vectors: rows packed into one, so that pairs of blocks are joined instead of pairs of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Vectors of a block of queries and of a block of candidates.
QUERY_ROWS, ROWS = 256, 1024


def directed(vec: str) -> Column:
    """The vector in doubles; empty if it has no direction (null, empty, zero, or with a component that is null or not finite)."""
    v = F.col(vec)
    x = F.transform(v, lambda c: c.cast("double"))
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(x, lambda c: c != 0)
    return F.when(F.coalesce(good, F.lit(False)), x).otherwise(F.array().cast("array<double>"))


def cosines(x: np.ndarray, y: np.ndarray, digits: int) -> np.ndarray:
    """Cosines of all pairs of rows, rounded with halves away from zero."""
    c = (x @ y.T) / np.sqrt(np.einsum("ij,ij->i", x, x)[:, None] * np.einsum("ij,ij->i", y, y)[None, :])
    return np.copysign(np.floor(np.abs(c) * 10.0**digits + 0.5), c) / 10.0**digits + 0.0


def closest(pairs: DataFrame, k: int, digits: int) -> DataFrame:
    """pairs: a block of queries (query_id; columns q_) beside one of candidates (vec_id and label; columns c_). Of each pair of blocks, every query's
    k best candidates by cosine, then id; without a cosine (no direction, unlike lengths) they come last."""
    kinds = {n: pairs.schema[n].dataType.elementType for n in ("q_query_id", "c_vec_id", "c_label")}
    schema = pa.schema([("query_id", to_arrow_type(kinds["q_query_id"])), ("vec_id", to_arrow_type(kinds["c_vec_id"])), ("label", to_arrow_type(kinds["c_label"])), ("cosine", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(n) for n in batch.schema.names}
            for r in range(batch.num_rows):
                q, c, labels = (col[n][r].values for n in ("q_query_id", "c_vec_id", "c_label"))
                dq, dc = col["q_dim"][r].as_py(), col["c_dim"][r].as_py()
                ids, own = c.to_numpy(zero_copy_only=False), q.to_numpy(zero_copy_only=False)
                order = np.argsort(ids, kind="stable")
                if dq == dc > 0:
                    x, y = (np.frombuffer(col[n][r].as_py(), "<f8").reshape(-1, dq) for n in ("q_vecs", "c_vecs"))
                    s = cosines(x, y[order], digits)
                else:
                    s = np.full((len(own), len(ids)), np.nan)
                i, j = [], []
                for p in range(len(own)):
                    others = np.flatnonzero(ids[order] != own[p])
                    best = others[np.argsort(-s[p, others], kind="stable")[:k]]  # nan last, then by id
                    i += [p] * len(best)
                    j += best.tolist()
                score = s[i, j]
                at = pa.array(order[j])
                yield pa.RecordBatch.from_arrays([q.take(pa.array(i, pa.int64())), c.take(at), labels.take(at), pa.array(score, mask=np.isnan(score))], schema=schema)

    return pairs.mapInArrow(run, f"query_id {kinds['q_query_id'].simpleString()}, vec_id {kinds['c_vec_id'].simpleString()}, label {kinds['c_label'].simpleString()}, cosine double")
