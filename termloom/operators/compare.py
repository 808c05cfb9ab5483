"""Comparison of runs and tools: pairing, agreement, transitions, alignment, deltas, reconciliation, dominance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import greatest_before


def paired(runs: DataFrame, *, id_col: str, mode_col: str, modes: list[str], fields: list[str]) -> DataFrame:
    """A row an id that all modes have, with every field a mode: field_mode. One aggregation, no joins."""
    cell = lambda f, m: F.max(F.when(F.col(mode_col) == m, F.col(f))).alias(f"{f}_{m}")
    has = [F.count_if(F.col(mode_col) == m).alias(f"_n_{m}") for m in modes]
    out = runs.where(F.col(mode_col).isin(*modes)).groupBy(id_col).agg(*[cell(f, m) for f in fields for m in modes], *has)
    return out.where(reduce(lambda a, b: a & b, [F.col(f"_n_{m}") > 0 for m in modes])).drop(*[f"_n_{m}" for m in modes])


def agreement(a: Column, b: Column) -> Column:
    """An aggregate: the share of rows in which both agree; two nulls agree."""
    return F.coalesce(F.avg(a.eqNullSafe(b).cast("double")), F.lit(0.0))


def transitions(a: Column, b: Column) -> list[Column]:
    """Counts of right and wrong before and after; a null is neither."""
    yes = lambda x: F.coalesce(x, F.lit(False))
    no = lambda x: F.coalesce(~x, F.lit(False))
    return [F.count_if(yes(a) & yes(b)).alias("both_right"), F.count_if(yes(a) & no(b)).alias("lost"), F.count_if(no(a) & yes(b)).alias("gained"), F.count_if(no(a) & no(b)).alias("both_wrong")]


def mismatches(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Ids that one side lacks, or whose fields differ; nulls are equal."""
    left, right = a.select(key, F.struct(*fields).alias("x")), b.select(key, F.struct(*fields).alias("y"))
    both = left.join(right, key, "full_outer")
    why = F.when(F.col("x").isNull(), "missing left").when(F.col("y").isNull(), "missing right").when(~F.col("x").eqNullSafe(F.col("y")), "differs")
    return both.select(key, why.alias("reason")).where(F.col("reason").isNotNull())


def aligned(ours: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    """Both sides by exact keys, a row a key of either: n_ours, n_theirs, and reason: matched, ambiguous (several different
    results on a side), missing ours or theirs. Equal repeats count once. ours, theirs: keys and result."""
    side = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(f"n_{name}"), F.count_distinct("result").alias(f"d_{name}"), F.max("result").alias(f"result_{name}"))
    both = side(ours, "ours").join(side(theirs, "theirs"), keys, "full_outer")
    reason = F.when(F.col("n_ours").isNull(), "missing ours").when(F.col("n_theirs").isNull(), "missing theirs").when((F.col("d_ours") > 1) | (F.col("d_theirs") > 1), "ambiguous").otherwise("matched")
    return both.select(*keys, F.coalesce("n_ours", F.lit(0)).alias("n_ours"), F.coalesce("n_theirs", F.lit(0)).alias("n_theirs"), "result_ours", "result_theirs", reason.alias("reason"))


def quality_label(rate: Column) -> Column:
    return F.when(rate >= 0.95, "excellent").when(rate >= 0.9, "good").when(rate >= 0.75, "moderate").otherwise("poor")


def deltas(metrics: DataFrame, baseline: str, *, method: str = "method", keys: list[str]) -> DataFrame:
    """metrics: method, keys, value. Each method's difference from the baseline method's value."""
    base = metrics.where(F.col(method) == baseline).select(*keys, F.col("value").alias("base"))
    return metrics.where(F.col(method) != baseline).join(base, keys).select(method, *keys, "value", "base", (F.col("value") - F.col("base")).alias("delta"))


def reconciled(found: DataFrame, stated: DataFrame, key: str = "metric", *, rel: float = 1e-6, absolute: float = 1e-9) -> DataFrame:
    """Metrics of which a side lacks one, or whose values differ beyond the tolerance."""
    both = found.select(key, F.col("value").alias("found")).join(stated.select(key, F.col("value").alias("stated")), key, "full_outer")
    near = F.abs(F.col("found") - F.col("stated")) <= F.greatest(F.lit(absolute), F.lit(rel) * F.greatest(F.abs("found"), F.abs("stated")))
    return both.where(~F.coalesce(near, F.col("found").isNull() & F.col("stated").isNull()))


def pareto(rows: DataFrame, good: str, bad: str) -> DataFrame:
    """Rows that none beats: none has at least as much good and at most as much bad, and one of them strictly. In order of
    bad a row is efficient if it has more good than all before it, or equals one that has."""
    per = greatest_before(rows.groupBy(bad).agg(F.max(good).alias("_top")), bad, F.col("_top"), "_best")
    best = per.where(F.col("_best").isNull() | (F.col("_top") > F.col("_best"))).select(bad, F.col("_top").alias(good))
    return rows.join(best, [bad, good], "left_semi")
