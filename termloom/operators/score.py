"""Scores of ranked predictions against gold codes, a row each and summed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.gold import first_gold_rank, fractional, hit, prf, recall_at_gold, reciprocal
from ..functions.numbers import rate

# Relationships that count as related, and outcomes.
RELATED = ("More Specific", "More General", "Sibling")
OUTCOMES = ("Execution error", "Abstained", "Gold rank 1", "Gold rank 2-3", "Gold rank 4-5", "No gold in Top 5")


def scored(rows: DataFrame, *, ranks: str = "ranks", gold: str = "gold", status: str = "status", errors: str = "zero") -> DataFrame:
    """Adds gold_rank, top1, top3, top5, rr, recall. Errors: `zero` keeps such rows with what their ranks give, `drop` leaves
    them out, `miss` keeps them with a rank of null."""
    rows = rows.where(F.col(status) != "error") if errors == "drop" else rows
    rank = first_gold_rank(F.col(ranks), F.col(gold))
    rank = F.when(F.col(status) != "error", rank) if errors == "miss" else rank
    rows = rows.withColumn("gold_rank", rank)
    return rows.select("*", *[hit(F.col("gold_rank"), k).alias(f"top{k}") for k in (1, 3, 5)], reciprocal(F.col("gold_rank")).alias("rr"), recall_at_gold(F.col(ranks), F.col(gold)).alias("recall"))


def summed(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, top1, top3, top5, mrr, recall and recall_n of scored rows, zeros where there are none."""
    mean = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), *[mean(c).alias(c) for c in ("top1", "top3", "top5")], mean("rr").alias("mrr"), mean("recall").alias("recall_at_gold"), F.count("recall").alias("recall_n"))


def fractions(rows: DataFrame, *, ranks: str = "ranks", gold: str = "gold", status: str = "status", by: list[str] | None = None) -> DataFrame:
    """Weighted precision, recall and f1: fractional counts are summed first and divided then. Whether a row is mapped is
    decided before its ranks are looked at; error rows are left out."""
    rows = rows.where(F.col(status) != "error")
    mapped = F.col(status) == "mapped"
    rank = F.when(mapped, first_gold_rank(F.col(ranks), F.col(gold)))
    rows = rows.withColumn("rank", rank).withColumn("f", fractional(mapped, F.col("rank"), F.col(gold)))
    totals = rows.groupBy(*(by or [])).agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(f"f.{c}"), F.lit(0.0)).alias(c) for c in ("tp", "fp", "fn", "tn")], F.count_if(F.col("rank") == 1).alias("top1_count"), F.count_if(F.col("rank").isNotNull()).alias("top5_count"))
    n = F.col("rows")
    return totals.select("*", *prf(F.col("tp"), F.col("fp"), F.col("fn")), rate(F.col("top1_count"), n, empty=0.0).alias("top1_accuracy"), rate(F.col("top5_count"), n, empty=0.0).alias("top5_rate"))


def taxonomy(status: Column, rank1: Column, gold: Column, relationship: Column) -> Column:
    """TP-Identical, TP-Related, FP-Error, FN or Not Applicable."""
    has = F.size(gold) > 0
    none = status.isin("unmapped", "error") | rank1.isNull()
    right = F.when(F.array_contains(gold, rank1), "TP-Identical").when(relationship.isin(*RELATED), "TP-Related").otherwise("FP-Error")
    return F.when(none & has, "FN").when(~none & has, right).otherwise("Not Applicable")


def taxonomy_prf(rows: DataFrame, category: str = "category", *, exact_only: bool = False, by: list[str] | None = None) -> DataFrame:
    """Counts, precision, recall and f1 of the taxonomy. exact_only: related answers count as errors."""
    n = lambda *names: F.count_if(F.col(category).isin(*names))
    good, bad = (("TP-Identical",), ("TP-Related", "FP-Error")) if exact_only else (("TP-Identical", "TP-Related"), ("FP-Error",))
    totals = rows.groupBy(*(by or [])).agg(n(*good).alias("tp"), n(*bad).alias("fp"), n("FN").alias("fn"))
    return totals.select("*", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def abstained(status: Column, code: Column) -> Column:
    """A row without a code abstains, unless it failed."""
    return F.when(status == "error", False).otherwise((status == "unmapped") | F.coalesce(F.trim(code) == "", F.lit(True)))


def outcome(status: Column, code: Column, rank: Column) -> Column:
    return F.when(status == "error", OUTCOMES[0]).when(abstained(status, code), OUTCOMES[1]).when(rank == 1, OUTCOMES[2]).when(rank.between(2, 3), OUTCOMES[3]).when(rank.between(4, 5), OUTCOMES[4]).otherwise(OUTCOMES[5])


def distribution(rows: DataFrame, column: str, categories: tuple[str, ...], by: list[str] | None = None) -> DataFrame:
    """Count and share of each category, those without rows too; by groups, if by is given."""
    by = by or []
    counts = rows.groupBy(*by, column).agg(F.count("*").alias("count"))
    totals = rows.groupBy(*by).agg(F.count("*").alias("total"))
    grid = totals.select("*", F.explode(F.array(*[F.lit(c) for c in categories])).alias(column))
    joined = grid.join(counts, [*by, column], "left")
    return joined.select(*by, column, F.coalesce("count", F.lit(0)).alias("count"), rate(F.coalesce("count", F.lit(0)), F.col("total"), empty=0.0).alias("share"))


def long_form(row: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A wide row of numbers as rows metric, value."""
    keys = keys or []
    names = [c for c in row.columns if c not in keys]
    return row.select(*keys, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(keys, names, "metric", "value")
