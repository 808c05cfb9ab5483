"""Mending finished runs: what is to be run again, gold data corrected, results put together, checked and summed up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.gold import first_gold_rank, hit, reciprocal
from .score import scored


class PatchError(ValueError):
    """A run that can't be mended without guessing."""


def unmapped_subset(predictions: DataFrame, *, key: str = "query_id", status: str = "status", expected: int | None = None) -> DataFrame:
    """The unmapped rows, which are to be run again. Rows without an id, ids that come twice, and another number than expected are errors."""
    rows = predictions.where(F.col(status) == "unmapped")
    per = rows.groupBy(key).agg(F.count("*").alias("n"))
    found = per.agg(F.sum("n").alias("rows"), F.count_if(F.col(key).isNull()).alias("blank"), F.count_if(F.col("n") > 1).alias("repeated"), F.min(F.when(F.col("n") > 1, F.col(key))).alias("first")).first()
    if found.blank:
        raise PatchError("unmapped rows without an id")
    if found.repeated:
        raise PatchError(f"{found.repeated} ids come twice among unmapped rows, the first is {found.first}")
    if expected is not None and (found.rows or 0) != expected:
        raise PatchError(f"{found.rows or 0} unmapped rows, {expected} expected")
    return rows


def pair_expansion(pairs: DataFrame, predictions: DataFrame) -> DataFrame:
    """pairs: query_id, gold_code and more; predictions: query_id, ranks, status. A row a pair, scored by its own gold code alone; a
    pair without a prediction has status missing_prediction."""
    of = predictions.select("query_id", F.col("ranks").alias("_ranks"), F.col("status").alias("_status"))
    none = F.array_repeat(F.lit(None).cast("string"), 5)
    out = pairs.join(of, "query_id", "left").withColumn("ranks", F.coalesce("_ranks", none))
    out = out.withColumn("status", F.when(F.col("_ranks").isNotNull(), F.col("_status")).otherwise("missing_prediction")).drop("_ranks", "_status")
    out = out.withColumn("first_gold_rank", first_gold_rank(F.col("ranks"), F.array("gold_code")))
    return out.select("*", *[hit(F.col("first_gold_rank"), k).alias(f"top{k}_hit") for k in (1, 3, 5)], reciprocal(F.col("first_gold_rank")).alias("reciprocal_rank"))


def gold_corrected(predictions: DataFrame, canonical: DataFrame, *, key: str = "query_id") -> DataFrame:
    """predictions with the gold codes and labels (arrays gold, gold_labels) of canonical and scores of these; affected tells whose gold
    changed, old_gold what it was. What a mapper gave stays. A prediction that canonical has no query for is an error."""
    new = canonical.select(F.col(key).alias("_key"), F.col("gold").alias("_gold"), F.col("gold_labels").alias("_labels"), F.lit(True).alias("_there"))
    rows = predictions.join(new, F.col(key) == F.col("_key"), "left")
    missing = F.raise_error(F.concat(F.lit("no canonical query for "), F.col(key).cast("string")))
    gold = F.when(F.col("_there"), F.col("_gold")).otherwise(missing.cast(new.schema["_gold"].dataType))
    changed = ~F.col("gold").eqNullSafe(F.col("_gold")) | ~F.col("gold_labels").eqNullSafe(F.col("_labels"))
    rows = rows.withColumn("affected", changed).withColumn("old_gold", F.col("gold")).withColumn("gold", gold).withColumn("gold_labels", F.col("_labels"))
    derived = ["gold_rank", "top1", "top3", "top5", "rr", "recall"]
    return scored(rows.drop("_key", "_gold", "_labels", "_there", *derived))


def differences(base: DataFrame, other: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A row an id and field in which two tables differ: key, field, base and other (as text). Nulls are equal."""
    left = base.select(key, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("_a"))
    right = other.select(key, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("_b"))
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_a.{f}").alias("base"), F.col(f"_b.{f}").alias("other")) for f in fields])
    both = left.join(right, key).select(key, F.inline(F.filter(each, lambda x: ~x.base.eqNullSafe(x.other))))
    return both


def patch_validation(base: DataFrame, patched: DataFrame, targeted: DataFrame, *, key: str = "query_id", fixed: list[str], mapper: list[str]) -> DataFrame:
    """One row: numbers of rows, missing, unexpected and repeated ids, fields that must not change but did (fixed ones anywhere, a mapper's
    outside of the targeted ids), and whether the patch passed."""
    ids = base.groupBy(key).agg(F.count("*").alias("_b")).join(patched.groupBy(key).agg(F.count("*").alias("_p")), key, "full_outer")
    counts = ids.agg(
        F.coalesce(F.sum("_b"), F.lit(0)).alias("base_rows"), F.coalesce(F.sum("_p"), F.lit(0)).alias("patched_rows"), F.count_if(F.col("_p").isNull()).alias("missing_ids"),
        F.count_if(F.col("_b").isNull()).alias("unexpected_ids"), F.count_if(F.col("_p") > 1).alias("repeated_ids"),
    )
    n_targeted = targeted.select(key).distinct().agg(F.count("*").alias("targeted"))
    moved = differences(base, patched, key, fixed).agg(F.count("*").alias("fixed_changes"))
    outside = differences(base, patched, key, mapper).join(targeted.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("changes_outside"))
    one = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), [counts, n_targeted, moved, outside])  # a row each
    bad = reduce(lambda a, b: a + b, [F.col(c) for c in ("missing_ids", "unexpected_ids", "repeated_ids", "fixed_changes", "changes_outside")])
    return one.withColumn("passed", (bad == 0) & (F.col("base_rows") == F.col("patched_rows")))


def patch_summary(rerun: DataFrame, by: list[str] | None = None) -> DataFrame:
    """rerun: status, ranks, gold. How rows that were unmapped came out, and at which rank the gold code is."""
    rows = rerun.withColumn("_rank", first_gold_rank(F.col("ranks"), F.col("gold")))
    n = lambda s: F.count_if(F.col("status") == s)
    return rows.groupBy(*(by or [])).agg(
        n("unmapped").alias("still_unmapped"), n("mapped").alias("now_mapped"), n("error").alias("now_error"), F.count("*").alias("total_rerun"),
        *[F.count_if(F.col("_rank") == k).alias(f"gold_rank_{k}") for k in range(1, 6)], F.count_if(F.col("_rank").isNull()).alias("gold_absent"),
    )


def stability(original: DataFrame, rerun: DataFrame, *, key: str = "query_id") -> DataFrame:
    """Of the rows run again: the shares that agree with the original in code, top-1 and top-5, and how many were mapped and aren't. A rerun
    whose id the original lacks agrees in nothing; two nulls agree. Null shares without rows."""
    fields = ("mapped_code", "top1", "top5")
    old = original.select(key, *[F.col(f).alias(f"_{f}") for f in (*fields, "status")], F.lit(True).alias("_there"))
    rows = rerun.join(old, key, "left")
    there = F.coalesce("_there", F.lit(False))
    agree = lambda f: F.avg((there & F.col(f).eqNullSafe(F.col(f"_{f}"))).cast("double"))
    lost = there & (F.col("_status") == "mapped") & (F.col("status") == "unmapped")
    return rows.agg(F.count("*").alias("sample_size"), agree("mapped_code").alias("code_agreement"), agree("top1").alias("top1_agreement"), agree("top5").alias("top5_agreement"), F.count_if(lost).alias("mapped_to_unmapped"))


def review_queue(rows: DataFrame, needs: Column) -> DataFrame:
    """Rows that a reviewer is to decide on, with empty columns for the decision."""
    empty = F.lit("")
    return rows.where(F.coalesce(needs, F.lit(False))).withColumns({"reviewer_decision": empty, "reviewer_notes": empty})


def decisions(reviewed: DataFrame, keys: list[str], *, decision: str = "reviewer_decision") -> DataFrame:
    """Keys and decision of the rows that a reviewer has decided on."""
    return reviewed.select(*keys, F.trim(decision).alias("decision")).where("decision <> ''")


def error_history(errors: DataFrame, attempt: int) -> DataFrame:
    """Failed rows as they go to the history of attempts, before they are tried again."""
    return errors.where(F.col("status") == "error").withColumn("attempt", F.lit(attempt))
