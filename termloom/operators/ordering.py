"""Numbers, running sums, running greatest values and percentiles over a whole table or large groups, in two levels, so that no task
sees all rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

#: Rows of a range, and the fewest ranges that a table is cut into; a group's totals of these are the only rows that meet in one task.
RANGE_ROWS, RANGES = 250_000, 32


def ranged(df: DataFrame, by: str, ranges: int | None = None) -> DataFrame:
    """df (written, as it is read again) with _range: the place of a number among approximate quantiles, as many as the rows need. Where exactly they lie changes no result."""
    ranges = ranges or max(RANGES, df.count() // RANGE_ROWS)
    cuts = sorted(set(df.stat.approxQuantile(by, [k / ranges for k in range(1, ranges)], 0.25 / ranges))) if ranges > 1 else []
    held = F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>") if cuts else F.array().cast("array<double>")
    return df.withColumn("_range", below(held, len(cuts), F.col(by)))


def below(held: Column, n: int, value: Column) -> Column:
    """How many of n numbers in order are less than value, by halving: the steps of a row grow with the logarithm of n."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))]).cast("array<int>")
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(held, at + step - 1) < value, at + step).otherwise(at))


def numbered(df: DataFrame, by: str, then: list[str], name: str, ranges: int | None = None) -> DataFrame:
    """df with dense numbers from 0 in the order of by (a number), then the other columns."""
    return accumulated(df.withColumn("_one", F.lit(1).cast("bigint")), by, then, F.col("_one"), name, ranges).drop("_one")


def accumulated(df: DataFrame, by: str, then: list[str], value: Column, name: str, ranges: int | None = None, group: list[str] | None = None) -> DataFrame:
    """df with the sum of value over all rows (of a group) before a row, 0 for the first."""
    return _running(df, by, then, value, name, ranges, group, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def greatest_before(df: DataFrame, by: str, value: Column, name: str, ranges: int | None = None, group: list[str] | None = None) -> DataFrame:
    """df with the greatest value of all rows (of a group) before a row, null for the first."""
    return _running(df, by, [], value, name, ranges, group, F.max, lambda a, b: F.greatest(a, b))


def _running(df, by, then, value, name, ranges, group, total, both) -> DataFrame:
    # read three times: for the ranges, their totals, and the rows
    rows = ranged(written(df.withColumn("_value", value).withColumn("_group", F.struct(*(group or [F.lit(0)])))), by, ranges)
    totals = rows.groupBy("_group", "_range").agg(total("_value").alias("_total"))
    before = total("_total").over(Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(F.col("_group").alias("_g"), F.col("_range").alias("_r"), before.alias("_before"))
    inside = total("_value").over(Window.partitionBy("_group", "_range").orderBy(by, *then).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_inside", inside)
    rows = rows.join(totals, (F.col("_group") == F.col("_g")) & (F.col("_range") == F.col("_r")))
    return rows.withColumn(name, both(F.col("_before"), F.col("_inside"))).drop("_range", "_value", "_before", "_inside", "_group", "_g", "_r")


def percentiles(rows: DataFrame, column: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Per group: exact percentiles with linear interpolation, named by shares; null without values. Values are counted first."""
    by = by or []
    counts = rows.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("_x")).agg(F.count("*").alias("_n"))
    counts = accumulated(counts, "_x", [], F.col("_n"), "_at", group=by)
    key = lambda df, name: df.withColumn(name, F.struct(*(by or [F.lit(0)])))
    totals = key(counts.groupBy(*by).agg(F.sum("_n").alias("_total")), "_g").select("_g", "_total")
    counts = key(counts, "_k").join(totals, F.col("_k") == F.col("_g"))
    out = []
    for name, p in shares.items():
        place = F.lit(p) * (F.col("_total") - 1)
        at = lambda k: F.max(F.when((F.col("_at") <= k) & (k < F.col("_at") + F.col("_n")), F.col("_x")))
        low, high = at(F.floor(place)), at(F.ceil(place))
        out.append((low + (high - low) * (F.first(place) - F.floor(F.first(place)))).alias(name))
    return counts.groupBy(*by).agg(*out)
