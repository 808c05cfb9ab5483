"""Runs: resuming, quarantine, patching, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import percentiles


def remaining(requests: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Requests that no finished row answers."""
    return requests.join(done.select(key).distinct(), key, "left_anti")


def quarantined(rows: DataFrame, status: str = "status") -> tuple[DataFrame, DataFrame]:
    """Rows to keep, and failed rows to be tried again."""
    bad = F.coalesce(F.col(status) == "error", F.lit(False))
    return rows.where(~bad), rows.where(bad)


def patched(base: DataFrame, rerun: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """base, with the fields of the rows that rerun has from there; patched tells which. Reruns of one id twice are errors, whichever
    columns are read."""
    new = rerun.groupBy(key).agg(*[F.first(f).alias(f"_{f}") for f in fields], F.count("*").alias("_n"))
    # the check is in the key that is joined by, which no projection leaves out
    once = F.when(F.col("_n") == 1, F.col(key)).otherwise(F.raise_error(F.lit("an id was rerun twice")).cast(new.schema[key].dataType))
    new = new.withColumn(key, once).withColumn("_there", F.lit(True))
    both = base.join(new, key, "left")
    there = F.col("_there").isNotNull()
    return both.select(key, *[F.when(there, F.col(f"_{f}")).otherwise(F.col(f)).alias(f) for f in fields], there.alias("patched"))


def strays(base: DataFrame, rerun: DataFrame, key: str) -> DataFrame:
    """Reruns of ids that base lacks."""
    return rerun.join(base.select(key).distinct(), key, "left_anti")


def telemetry(rows: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean, median and 95th percentile (exact, interpolated), sum and number of values of each column."""
    by = by or []
    out = rows.groupBy(*by).agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("sum", F.sum), ("n", F.count))])
    key = F.struct(*(by or [F.lit(0)]))
    out = out.withColumn("_k", key)
    for c in columns:
        p = percentiles(rows, c, {f"{c}_median": 0.5, f"{c}_p95": 0.95}, by)
        p = p.select(key.alias("_p"), f"{c}_median", f"{c}_p95")
        out = out.join(p, F.col("_k") == F.col("_p"), "left").drop("_p")
    return out.select(*by, *[f"{c}_{n}" for c in columns for n in ("mean", "median", "p95", "sum", "n")])
