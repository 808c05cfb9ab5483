"""Gold codes and ranked predictions as array expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import MAX_RANK


def split_codes(c: Column, *, exact: bool = True) -> Column:
    """The codes of a cell, trimmed, without blanks. exact: only ` | ` divides them; else any `|` does."""
    parts = F.split(F.coalesce(c, F.lit("")), r" \| " if exact else r"\|")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def split_labels(c: Column, n: Column) -> Column:
    """A label for each of n codes, if the cell has as many; else nulls. `||` divides labels, or ` | `."""
    text = F.coalesce(c, F.lit(""))
    parts = F.transform(F.split(text, r" \| |\|\|"), lambda x: F.nullif(F.trim(x), F.lit("")))
    return F.when(F.size(parts) == n, parts).otherwise(F.array_repeat(F.lit(None).cast("string"), n))


def first_gold_rank(ranks: Column, gold: Column) -> Column:
    """The 1-based rank of the first of the scored ranks that holds a gold code; else null."""
    hits = F.transform(F.slice(ranks, 1, MAX_RANK), lambda c, i: F.when((c != "") & F.array_contains(gold, c), i + 1))
    return F.array_min(hits)


def hit(rank: Column, k: int) -> Column:
    return F.coalesce(rank <= k, F.lit(False))


def reciprocal(rank: Column) -> Column:
    return F.coalesce(F.lit(1).cast("double") / rank, F.lit(0.0))


def recall_at_gold(ranks: Column, gold: Column) -> Column:
    """The share of the distinct gold codes that the first n ranks hold, n their number but the scored ranks at most."""
    distinct = F.array_distinct(F.filter(gold, lambda x: x != ""))
    n = F.size(distinct)
    top = F.slice(ranks, F.lit(1), F.greatest(F.least(n, F.lit(MAX_RANK)), F.lit(1)))
    return F.when(n > 0, F.size(F.array_intersect(distinct, top)) / n)


def fractional(mapped: Column, rank: Column, gold: Column) -> Column:
    """A struct tp, fp, fn, tn: rank r counts as half as much true for each rank further down; what is missing is
    shared by fp and fn evenly."""
    tp = reduce(lambda out, r: F.when(rank == r, F.lit(0.5 ** (r - 1))).otherwise(out), range(1, MAX_RANK + 1), F.lit(0.0))
    has = F.size(gold) > 0
    half = F.when(mapped, (1 - tp) / 2).otherwise(0.0)
    return F.struct(
        F.when(mapped, tp).otherwise(0.0).alias("tp"), half.alias("fp"),
        F.when(mapped, half).when(has, 1.0).otherwise(0.0).alias("fn"), F.when(~mapped & ~has, 1.0).otherwise(0.0).alias("tn"),
    )


def five(codes: Column) -> Column:
    """Exactly as many slots as ranks are scored, filled up with nulls."""
    return F.slice(F.concat(codes, F.array_repeat(F.lit(None).cast("string"), MAX_RANK)), 1, MAX_RANK)


def same_set(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same codes, nulls aside."""
    own = lambda x: F.array_sort(F.array_distinct(F.filter(x, lambda c: c.isNotNull() & (c != ""))))
    return own(a) == own(b)


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall and f1 of summed counts; 0 where nothing is to be divided by."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1")]
