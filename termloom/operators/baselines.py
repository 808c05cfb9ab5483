"""Published results of other tools: checked tables, set beside a run's own, and how both relate to the hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import rate
from .evaluate import exclusive_bins

# Metrics that a published table has to have, and the classes of the hierarchy with what lies outside of them.
METRICS = {"Top-1": "top1", "Top-3": "top3", "Top-5": "top5", "MRR": "mrr"}
RELATIONSHIPS = ("Same", "More Specific", "More General", "Sibling", "Unrelated")
NO_PREDICTION, UNAVAILABLE = "No Top-1 prediction", "unavailable"


class BaselineError(ValueError):
    """A published table that can't be trusted."""


def refused(rows: DataFrame, rules: dict[str, Column]) -> None:
    """Ends with an error that names the first broken rule; a rule is a condition that no row may fulfil."""
    counts = rows.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in rules.items()]).first()
    bad = [n for n in rules if counts[n]]
    if bad:
        raise BaselineError(f"{bad[0]}: {counts[bad[0]]} rows")


def checked(rows: DataFrame, *, benchmarks: list[str], tools: list[str]) -> DataFrame:
    """rows: benchmark, tool, metric, value, denominator. A row a benchmark and tool: n and its metrics. Unknown names, repeated or missing rows,
    values outside [0, 1] and several denominators are errors."""
    value = F.col("value").try_cast("double")
    refused(rows, {"unknown benchmark": ~F.col("benchmark").isin(*benchmarks), "unknown tool": ~F.col("tool").isin(*tools), "unknown metric": ~F.col("metric").isin(*METRICS), "malformed value": ~value.between(0.0, 1.0)})
    per = rows.groupBy("benchmark", "tool", "metric").agg(F.count("*").alias("n"))
    refused(per, {"repeated row": F.col("n") > 1})
    of = lambda m: F.max(F.when(F.col("metric") == m, value))
    out = rows.groupBy("benchmark", "tool").agg(F.max(F.col("denominator").try_cast("bigint")).alias("n"), F.count_distinct("denominator").alias("_d"), F.count("*").alias("_m"), *[of(m).alias(c) for m, c in METRICS.items()])
    refused(out, {"several denominators": F.col("_d") != 1, "missing metric": F.col("_m") != len(METRICS)})
    if out.count() != len(benchmarks) * len(tools):
        raise BaselineError("missing benchmark or tool")
    return out.drop("_d", "_m")


def all_methods(own: DataFrame, published: DataFrame, name: str = "ours") -> DataFrame:
    """own: benchmark, n and metrics. All methods' metrics in one table, with the shares of exclusive ranks."""
    rows = own.withColumn("tool", F.lit(name)).unionByName(published)
    return rows.select("benchmark", F.col("tool").alias("method"), "n", *METRICS.values(), *exclusive_bins(F.col("top1"), F.col("top3"), F.col("top5")))


def side_by_side(own: DataFrame, published: DataFrame, tools: list[str], benchmark: str) -> DataFrame:
    """own: metric, value; published: benchmark, tool, metric, value. A row a metric of either: cells with four digits, or that there is no value."""
    rows = published.where((F.col("benchmark") == benchmark) & F.lower("tool").isin(*tools))
    wide = rows.groupBy("metric").agg(*[F.max(F.when(F.lower("tool") == t, F.col("value").cast("string"))).alias(t) for t in tools])
    both = own.select("metric", F.format_string("%.4f", F.col("value").cast("double")).alias("this_study"), F.col("value").isNull().alias("_none")).join(wide, "metric", "full_outer")
    mine = F.when(~F.coalesce("_none", F.lit(True)), F.col("this_study"))
    return both.select("metric", *[F.coalesce(t, F.lit(UNAVAILABLE)).alias(t) for t in tools], F.coalesce(mine, F.lit(UNAVAILABLE)).alias("this_study"))


def checked_relationships(rows: DataFrame, benchmarks: list[str], tolerance: float = 0.005) -> DataFrame:
    """rows: benchmark, relationship, n, count, proportion. The same, if each benchmark has every relationship once, counts that add up to its
    n, and proportions that fit."""
    refused(rows, {"unknown benchmark": ~F.col("benchmark").isin(*benchmarks), "unknown relationship": ~F.col("relationship").isin(*RELATIONSHIPS), "proportion": F.abs(F.col("proportion") - F.col("count") / F.col("n")) > tolerance})
    per = rows.groupBy("benchmark").agg(F.count("*").alias("rows"), F.count_distinct("relationship").alias("kinds"), F.count_distinct("n").alias("ns"), F.max("n").alias("n"), F.sum("count").alias("total"))
    refused(per, {"repeated or missing relationship": (F.col("rows") != len(RELATIONSHIPS)) | (F.col("kinds") != len(RELATIONSHIPS)), "several n": F.col("ns") != 1, "counts don't add up to n": F.col("total") != F.col("n")})
    return rows


def relationship_shares(rows: DataFrame, *, by: list[str], relationship: str = "relationship") -> DataFrame:
    """rows: a prediction each. Per group and relationship: count, the share of mapped rows (null for what has no prediction) and of all rows;
    every relationship comes, also without rows."""
    kind = F.when(F.col(relationship).isin(*RELATIONSHIPS), F.col(relationship)).otherwise(NO_PREDICTION)
    counts = rows.groupBy(*by, kind.alias("relationship")).agg(F.count("*").alias("count"))
    totals = counts.groupBy(*by).agg(F.sum("count").alias("n"), F.sum(F.when(F.col("relationship") != NO_PREDICTION, F.col("count")).otherwise(0)).alias("mapped_n"))
    grid = totals.select("*", F.explode(F.array(*[F.lit(r) for r in (*RELATIONSHIPS, NO_PREDICTION)])).alias("relationship"))
    out = grid.join(counts, [*by, "relationship"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    mapped = F.when(F.col("relationship") != NO_PREDICTION, rate(F.col("count"), F.col("mapped_n"), empty=0.0))
    return out.select(*by, "relationship", "count", "mapped_n", "n", mapped.alias("mapped_only_share"), rate(F.col("count"), F.col("n"), empty=0.0).alias("end_to_end_share"))


def denominators(own: DataFrame, published: DataFrame) -> DataFrame:
    """own: benchmark, n, mapped_n; published: benchmark, n. Both sides' numbers, and whether they are the same."""
    theirs = published.select("benchmark", F.col("n").alias("their_n")).distinct()
    return own.join(theirs, "benchmark").select("benchmark", "n", "mapped_n", (F.col("n") - F.col("mapped_n")).alias("no_prediction_n"), "their_n", (F.col("n") == F.col("their_n")).alias("same"))


def alignment_rates(aligned: DataFrame, *, single_gold: Column | None = None) -> DataFrame:
    """aligned: rows of compare.aligned. Matched keys, keys of one side only, and the shares of matches: among our keys with one gold code
    (a condition, all by default), and among all of theirs; with the label of the smaller one."""
    from .compare import quality_label

    ours = F.col("reason") != "missing ours"
    single = ours if single_gold is None else ours & single_gold
    n = F.count_if
    out = aligned.agg(
        n(F.col("reason") == "matched").alias("matched"), n(F.col("reason") == "ambiguous").alias("ambiguous"), n(F.col("reason") == "missing theirs").alias("ours_unmatched"), n(F.col("reason") == "missing ours").alias("theirs_unmatched"),
        n(single).alias("single_gold"), n(F.col("reason") != "missing theirs").alias("theirs"), n(single & (F.col("reason") == "matched")).alias("_m"),
    )
    out = out.select("matched", "ambiguous", "ours_unmatched", "theirs_unmatched", rate(F.col("_m"), F.col("single_gold"), empty=0.0).alias("match_rate_ours"), rate(F.col("matched"), F.col("theirs"), empty=0.0).alias("match_rate_theirs"))
    return out.withColumn("quality", quality_label(F.least("match_rate_ours", "match_rate_theirs")))


def promotable(quality: DataFrame) -> DataFrame:
    """quality: a row a benchmark with quality and agreement (of classes made anew with the published ones). Whether the aligned comparison may stand
    first: every alignment is excellent or good, and every agreement 0.99 at least."""
    ok = F.col("quality").isin("excellent", "good") & (F.col("agreement") >= 0.99)
    return quality.agg(F.coalesce(F.bool_and(F.coalesce(ok, F.lit(False))), F.lit(False)).alias("promotable"), F.count("*").alias("benchmarks"))


def reclassified(rows: DataFrame, stated: str, found: str) -> DataFrame:
    """How often a stated class comes out as each found one, and the share of rows in which both agree."""
    counts = rows.groupBy(F.col(stated).alias("stated"), F.col(found).alias("found")).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("_n"), F.sum(F.when(F.col("stated").eqNullSafe(F.col("found")), F.col("count")).otherwise(0)).alias("_same"))
    return counts.crossJoin(F.broadcast(total)).select("stated", "found", "count", rate(F.col("_same"), F.col("_n")).alias("agreement"))
