"""Circuit breakers over ordered results: runs of failures in a row, per source, with two counters.

A result (mapped or unmapped) sets both counters to zero. An error of local retrieval adds to both; any other error adds to the counter of all errors and leaves that of
local errors alone; rows of any other status change nothing. A breaker opens at the first local error that makes the local run reach its limit, or at the first
other error that makes the run of all errors reach its own.

Runs are an associative scan: rows are cut into ranges of their order, and a range of a source is summed up as whether it has a result, and its errors since the last one (all
of them without one). Such summaries compose in order, so only they meet in one task for each source, and rows meet in tasks of a range; a source with a third of all rows is no single
sort. What came before (the state of an earlier batch) composes the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import ranged
from .store import written

# Results that end a run, the stage that counts as local, reasons for opening.
RESULTS, LOCAL = ("mapped", "unmapped"), "local_retrieval"
LOCAL_REASON, ANY_REASON = "consecutive_local_retrieval_errors", "consecutive_execution_errors"
STATE = "local_run bigint, any_run bigint, longest_local bigint, longest_any bigint, opened_at bigint, reason string"


def streaks(rows: DataFrame, *, group: str, ord_: str, status: str = "status", stage: str = "error_stage", before: DataFrame | None = None, ranges: int | None = None) -> DataFrame:
    """group, ord_, local (whether a row is a local error), bad (whether it is an error), local_run and any_run (errors in a row up to and with it). ord_: a whole number, once a group. before:
    group, local_run and any_run of earlier rows."""
    bad = F.coalesce(F.col(status) == "error", F.lit(False))
    events = rows.select(
        F.col(group).alias("_g"), F.col(ord_).cast("bigint").alias("_o"), F.coalesce(F.col(status).isin(*RESULTS), F.lit(False)).cast("bigint").alias("_reset"),
        bad.alias("bad"), (bad & F.coalesce(F.col(stage) == LOCAL, F.lit(False))).alias("local"),
    )
    # read for the cuts, the summaries and the rows
    cut = ranged(written(events), "_o", ranges)
    here = Window.partitionBy("_g", "_range").orderBy("_o")
    cut = cut.withColumn("_resets", F.sum("_reset").over(here))
    since = Window.partitionBy("_g", "_range", "_resets").orderBy("_o")
    cut = cut.withColumn("_l", F.sum(F.col("local").cast("bigint")).over(since)).withColumn("_a", F.sum(F.col("bad").cast("bigint")).over(since))
    ends = cut.groupBy("_g", "_range").agg(F.max("_resets").alias("_r"), F.max_by("_l", "_o").alias("_tail_l"), F.max_by("_a", "_o").alias("_tail_a"))
    order = Window.partitionBy("_g").orderBy("_range")  # a row a range
    ends = ends.withColumn("_segment", F.sum((F.col("_r") > 0).cast("bigint")).over(order))
    along = Window.partitionBy("_g", "_segment").orderBy("_range")
    ends = ends.withColumn("_sum_l", F.sum("_tail_l").over(along)).withColumn("_sum_a", F.sum("_tail_a").over(along))
    carried = ends.select(
        F.col("_g").alias("_g2"), F.col("_range").alias("_range2"), *[F.lag(f"_sum_{c}", 1, 0).over(order).alias(f"_in_{c}") for c in "la"], F.lag("_segment", 1, 0).over(order).alias("_before"),
    )
    if before is not None:  # it reaches up to the first result of all
        old = before.select(F.col(group).alias("_g3"), *[F.coalesce(f"{n}_run", F.lit(0)).alias(f"_old_{c}") for n, c in (("local", "l"), ("any", "a"))])
        carried = carried.join(old, F.col("_g2").eqNullSafe(F.col("_g3")), "left")
        for c in "la":
            first = F.when(F.col("_before") == 0, F.coalesce(f"_old_{c}", F.lit(0))).otherwise(F.lit(0))
            carried = carried.withColumn(f"_in_{c}", F.col(f"_in_{c}") + first)
    both = cut.join(carried, F.col("_g").eqNullSafe(F.col("_g2")) & (F.col("_range") == F.col("_range2")))
    run = lambda c: F.col(f"_{c}") + F.when(F.col("_resets") == 0, F.col(f"_in_{c}")).otherwise(F.lit(0))
    return both.select(F.col("_g").alias(group), F.col("_o").alias(ord_), "local", "bad", run("l").alias("local_run"), run("a").alias("any_run"))


def opens(local_limit: int, any_limit: int) -> Column:
    """Why a breaker opens at a row of streaks(); null if it doesn't."""
    return F.when(F.col("local") & (F.col("local_run") >= local_limit), LOCAL_REASON).when(F.col("bad") & ~F.col("local") & (F.col("any_run") >= any_limit), ANY_REASON)


def breakers(rows: DataFrame, *, group: str, ord_: str, status: str = "status", stage: str = "error_stage", local_limit: int = 3, any_limit: int = 5, before: DataFrame | None = None, ranges: int | None = None) -> DataFrame:
    """Per group: runs at its end, the longest ones, and where and why its breaker opened first. before: the same of earlier rows; its groups without new rows are left out."""
    found = streaks(rows, group=group, ord_=ord_, status=status, stage=stage, before=before, ranges=ranges).withColumn("why", opens(local_limit, any_limit))
    first = F.min(F.when(F.col("why").isNotNull(), F.struct(F.col(ord_).alias("o"), "why")))
    last = lambda n: F.max_by(n, ord_).alias(n)
    out = found.groupBy(group).agg(last("local_run"), last("any_run"), F.max("local_run").alias("longest_local"), F.max("any_run").alias("longest_any"), first.alias("first"))
    out = out.select(group, "local_run", "any_run", "longest_local", "longest_any", F.col("first.o").alias("opened_at"), F.col("first.why").alias("reason"))
    if before is None:
        return out
    old = before.select(F.col(group).alias("_g"), *[F.col(n).alias(f"_{n}") for n in ("longest_local", "longest_any", "opened_at", "reason")])
    both = out.join(old, F.col(group).eqNullSafe(F.col("_g")), "left")
    opened = F.col("_opened_at").isNotNull()
    return both.select(
        group, "local_run", "any_run", *[F.greatest(n, f"_{n}").alias(n) for n in ("longest_local", "longest_any")],
        F.when(opened, F.col("_opened_at")).otherwise(F.col("opened_at")).alias("opened_at"), F.when(opened, F.col("_reason")).otherwise(F.col("reason")).alias("reason"),
    )
