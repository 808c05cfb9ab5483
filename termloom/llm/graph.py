"""Connected components of links between rows, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, stored

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """edges: a and b, whole numbers. Returns, stored, id and component, the smallest id reachable, for every id with a link to another.

    Alternates two star steps until nothing changes: every node's larger neighbours are linked to its smallest neighbour (or
    itself), then every node and its smaller neighbours are linked to the smallest of them. Sums of a node's links are partial
    aggregates, and what joins a hot node is a join that Spark can split. Rounds grow with the logarithm of the longest chain.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = _state(now)
    for _ in range(ROUNDS):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        last, now = now, stored(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        freed(last)
        was, seen = seen, _state(now)
        if was == seen:
            break
    else:
        raise RuntimeError(f"links did not settle in {ROUNDS} rounds")
    ends = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    out = stored(ends.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()))
    freed(now)
    return out


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)
