"""Calibration of confidences: ROC AUC, Brier score, expected calibration error, separation.

Ranks come from counts of distinct scores and running sums in two levels, so that no task sees all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.statistics import p_value
from ..schemas import hard_fail
from .ordering import accumulated
from .summaries import beside

BINS = 10


def valid_confidence(c: Column) -> Column:
    """A confidence outside [0, 1] is an error and never clipped."""
    return hard_fail(c, c.between(0.0, 1.0), "a confidence lies outside [0, 1]")


def rank_sums(rows: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Per group: n1, n0 and r1, the sum of the average ranks of the rows labelled 1."""
    by = by or []
    per = rows.groupBy(*by, F.col(score).alias("s")).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("n1"))
    per = accumulated(per, "s", [], F.col("n"), "before", group=by).withColumn("rank", F.col("before") + (F.col("n") + 1) / 2)
    sums = (F.sum("n1").alias("n1"), F.sum(F.col("n") - F.col("n1")).alias("n0"), F.sum(F.col("n1") * F.col("rank")).alias("r1"))
    return per.groupBy(*by).agg(*sums).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n1", "n0")})


def area(n1: Column, n0: Column, r1: Column) -> Column:
    """The area under the curve from the sums of ranks; null where a class is missing."""
    return F.when((n1 > 0) & (n0 > 0), (r1 - n1 * (n1 + 1) / 2) / (n1 * n0))


def roc_auc(rows: DataFrame, label: str = "label", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """Per group: n1, n0, auc (null if a class is missing) and status."""
    auc = area(F.col("n1"), F.col("n0"), F.col("r1"))
    status = F.when(auc.isNotNull(), "OK").otherwise("NOT_COMPUTABLE")
    return rank_sums(rows, label, score, by).select(*(by or []), "n1", "n0", auc.alias("auc"), status.alias("status"))


def brier(label: Column, score: Column) -> Column:
    """An aggregate; null without rows."""
    return F.avg(F.pow(score - label, F.lit(2)))


def bins(rows: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """bin, count, mean_confidence, accuracy and gap for each of ten equal bins; empty ones have nulls. 1 lies in the last."""
    b = F.least(F.floor(F.col(score) * BINS), F.lit(BINS - 1)).cast("int")
    per = rows.groupBy(b.alias("bin")).agg(F.count("*").alias("count"), F.avg(score).alias("mean_confidence"), F.avg(F.col(label).cast("double")).alias("accuracy"))
    grid = rows.sparkSession.range(BINS).select(F.col("id").cast("int").alias("bin"))
    return grid.join(per, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("count"), "mean_confidence", "accuracy", F.abs(F.col("accuracy") - F.col("mean_confidence")).alias("gap"))


def ece(binned: DataFrame) -> DataFrame:
    """The bins' gaps weighted by their counts; null without rows."""
    return binned.agg((F.sum(F.col("gap") * F.col("count")) / F.sum("count")).alias("ece"), F.max("gap").alias("max_gap"))


def separation(rows: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Of right and wrong answers' confidences: counts, means, deviations, the rank-sum statistic z with its two-sided p, and Cohen's d. The
    statistic is not corrected for ties."""
    sums = rank_sums(rows, label, score)
    y = F.col(label) == 1
    of = rows.agg(*[f(F.when(c, F.col(score))).alias(f"{n}_{side}") for side, c in (("right", y), ("wrong", ~y)) for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])
    n1, n0 = F.col("n1"), F.col("n0")
    z = (F.col("r1") - n1 * (n1 + n0 + 1) / 2) / F.sqrt(n1 * n0 * (n1 + n0 + 1) / 12)
    pooled = F.sqrt(((n1 - 1) * F.pow("sd_right", F.lit(2)) + (n0 - 1) * F.pow("sd_wrong", F.lit(2))) / (n1 + n0 - 2))
    both = (n1 > 0) & (n0 > 0)
    return sums.join(of, F.lit(True)).select("n1", "n0", "mean_right", "mean_wrong", "sd_right", "sd_wrong", F.when(both, z).alias("z"), F.when(both, p_value(z)).alias("p"), F.when((n1 > 1) & (n0 > 1) & (pooled > 0), (F.col("mean_right") - F.col("mean_wrong")) / pooled).alias("cohens_d"))


def summary(rows: DataFrame, by: list[str], *, status: str = "status", label: str = "semantic_correctness", score: str = "confidence") -> DataFrame:
    """Per group, of mapped rows that have a confidence: calibration_n, roc_auc, brier_score, ece and cohens_d, each null where it can't be
    computed. A group without such rows has no row. Bins, and ranks of distinct scores, are totalled before any group is, so that a
    group that holds most rows is no one task's work."""
    held = F.col(score).isNotNull() & (F.col(status) == "mapped")
    pairs = rows.where(held).select(*by, valid_confidence(F.col(score)).alias("score"), F.coalesce(F.col(label).cast("int"), F.lit(0)).alias("label"))
    place = F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int")
    sums = (F.count("*").alias("n"), F.sum("score").alias("s"), F.sum("label").alias("y"), F.sum(F.pow(F.col("score") - F.col("label"), F.lit(2))).alias("b"))
    binned = pairs.groupBy(*by, place.alias("bin")).agg(*sums)
    gaps = F.sum(F.abs(F.col("y") - F.col("s")))
    of_bins = binned.groupBy(*by).agg(F.sum("n").alias("calibration_n"), (F.sum("b") / F.sum("n")).alias("brier_score"), (gaps / F.sum("n")).alias("ece"))
    right = F.col("label") == 1
    of = lambda f, c: f(F.when(c, F.col("score")))
    sides = pairs.groupBy(*by).agg(*[of(f, c).alias(f"_{n}{k}") for k, c in ((1, right), (0, ~right)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    n1, n0 = F.col("_n1"), F.col("_n0")
    pooled = F.sqrt(((n1 - 1) * F.col("_v1") + (n0 - 1) * F.col("_v0")) / (n1 + n0 - 2))
    d = F.when((n1 > 1) & (n0 > 1) & (pooled > 0), (F.col("_m1") - F.col("_m0")) / pooled)
    ranked = rank_sums(pairs, "label", "score", by).select(*by, area(F.col("n1"), F.col("n0"), F.col("r1")).alias("roc_auc"))
    return beside(beside(of_bins, ranked, by), sides.select(*by, d.alias("cohens_d")), by)
