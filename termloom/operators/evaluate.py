"""Benchmark evaluation: breakdowns by vocabulary and entity, end-to-end outcomes, latency and reproducibility summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.gold import same_set
from ..functions.identity import code_prefix
from ..functions.numbers import rate

# How answers are classed.
MATCHES = ("EXACT", "VALID_OTHER", "INVALID", "UNKNOWN", "UNMAPPED", "ERROR")
SENTINELS = ("UNMAPPED", "NONE", "", "UNKNOWN:UNMAPPED")
E2E = ("Execution error", "Unmapped", "Gold rank 1", "Gold rank 2", "Gold rank 3", "Gold rank 4", "Gold rank 5", "Mapped, gold not in Top 5")


def match_type(code: Column, gold: Column, valid: Column) -> Column:
    """valid: whether the vocabulary has the code, null if nothing can tell."""
    c = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    return F.when(c == "ERROR", "ERROR").when(c.isin(*SENTINELS), "UNMAPPED").when(F.exists(gold, lambda g: F.upper(g) == c), "EXACT").when(valid, "VALID_OTHER").when(~valid, "INVALID").otherwise("UNKNOWN")


def breakdown(rows: DataFrame, *, gold: str = "gold", entity: str = "entity", match: str = "match") -> DataFrame:
    """Counts of matches in total, by entity, and by the vocabulary of each gold code, in one pass of grouping sets: a row
    counts once in the total and its entity, and once a vocabulary that its gold codes name."""
    spread = rows.select(F.col(entity).alias("entity"), F.col(match).alias("match"), F.explode(F.array_append(F.array_distinct(F.filter(F.transform(gold, lambda g: F.struct(code_prefix(g).alias("v"))), lambda x: x.v.isNotNull())), F.struct(F.lit(None).cast("string").alias("v")))).alias("x"))
    spread = spread.select("entity", "match", F.col("x.v").alias("ontology"))
    counts = [F.count("*").alias("n"), *[F.count_if(F.col("match") == m).alias(m.lower()) for m in MATCHES]]
    whole = spread.where("ontology IS NULL").cube("entity").agg(F.grouping("entity").alias("g"), *counts).select(F.when(F.col("g") == 1, "total").otherwise("entity").alias("slice"), F.col("entity").alias("value"), "n", *[m.lower() for m in MATCHES])
    by = spread.where("ontology IS NOT NULL").groupBy("ontology").agg(*counts).select(F.lit("ontology").alias("slice"), F.col("ontology").alias("value"), "n", *[m.lower() for m in MATCHES])
    return whole.unionByName(by).withColumn("accuracy", rate(F.col("exact"), F.col("n"), empty=0.0))


def e2e_outcome(status: Column, rank: Column) -> Column:
    return F.when(status == "error", E2E[0]).when(status == "unmapped", E2E[1]).when(rank.isNull(), E2E[7]).otherwise(F.concat(F.lit("Gold rank "), rank.cast("string")))


def exclusive_bins(top1: Column, top3: Column, top5: Column) -> list[Column]:
    """Cumulative rates as shares of exclusive ranges of ranks."""
    return [top1.alias("rank_1"), F.greatest(top3 - top1, F.lit(0.0)).alias("rank_2_3"), F.greatest(top5 - top3, F.lit(0.0)).alias("rank_4_5"), F.greatest(1 - top5, F.lit(0.0)).alias("beyond")]


def latency(rows: DataFrame, total: str, parts: list[str], by: list[str] | None = None) -> DataFrame:
    """Means of the total and its parts, and what the parts leave; a slightly negative rest is 0, a clearly negative one null."""
    out = rows.groupBy(*(by or [])).agg(*[F.avg(c).alias(c) for c in [total, *parts]])
    rest = F.col(total)
    for p in parts:
        rest = rest - F.coalesce(F.col(p), F.lit(0.0))
    return out.withColumn("rest", F.when(rest >= 0, rest).when(rest >= -0.05, 0.0))


def reproducibility(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """a, b: key, status and ranks. Of the rows that failed in neither run: their number, the share of equal first ranks (two nulls
    are equal), and of equal sets of five."""
    x, y = [r.where(F.col("status") != "error").select(key, F.col("ranks").alias(n)) for r, n in ((a, "x"), (b, "y"))]
    mean = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    return x.join(y, key).agg(F.count("*").alias("n"), mean(F.col("x")[0].eqNullSafe(F.col("y")[0])).alias("top1_agreement"), mean(same_set(F.col("x"), F.col("y"))).alias("top5_agreement"))


def end_to_end_agreement(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """As reproducibility(), over all rows of both runs: a failed row agrees with a failed one only."""
    bad = F.array(F.lit("__ERROR__"))
    x, y = [r.select(key, F.when(F.col("status") == "error", bad).otherwise(F.col("ranks")).alias(n)) for r, n in ((a, "x"), (b, "y"))]
    mean = lambda c: F.avg(c.cast("double"))
    return x.join(y, key).agg(F.count("*").alias("n"), mean(F.col("x")[0].eqNullSafe(F.col("y")[0])).alias("top1_agreement"), mean(same_set(F.col("x"), F.col("y"))).alias("top5_agreement"))


def per_hundred(rows: DataFrame, flags: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """How often each condition holds in a hundred rows."""
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), *[(F.count_if(c) * 100 / F.count("*")).alias(name) for name, c in flags.items()])


def sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The n rows of the smallest hashes of key and seed."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def fingerprint(config: dict) -> str:
    """A digest of a run's settings, for resuming with the same ones only."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def same_config(old: dict, new: dict, fields: list[str]) -> None:
    """Ends with an error that names the settings that differ."""
    bad = [f for f in fields if old.get(f) != new.get(f)]
    if bad:
        raise ValueError(f"settings differ: {', '.join(bad)}")
