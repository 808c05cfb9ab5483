"""Scores, rates and costs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOISE = 1e-6


def clamp_unit(x: Column) -> Column:
    """x within [0, 1]; a bound, if x misses it by noise only; else null (NaN and infinities too)."""
    return F.when(x.isNull() | F.isnan(x), F.lit(None)).when(x.between(0.0, 1.0), x).when((x > 1) & (x <= 1 + NOISE), 1.0).when((x < 0) & (x >= -NOISE), 0.0)


def positional(rank: Column, kind: str = "linear") -> Column:
    """A source's score by place (from 0): falls by a twentieth a place, or with the place's inverse."""
    return 1 - 0.05 * rank if kind == "linear" else F.lit(1.0) / (1 + rank)


def rate(part: Column, whole: Column, *, empty: float | None = None) -> Column:
    """part / whole; null, or what is given, where there is nothing to divide by."""
    out = F.try_divide(part.cast("double"), whole.cast("double"))
    return out if empty is None else F.coalesce(out, F.lit(empty))


def cost(input_tokens: Column, cached: Column, output: Column, price_in: Column, price_cached: Column, price_out: Column) -> Column:
    """USD for a call's tokens at prices a million; null where no tokens are known."""
    known = F.coalesce(input_tokens, F.lit(0))
    held = F.least(F.coalesce(cached, F.lit(0)), known)
    total = F.greatest(known - held, F.lit(0)) / 1e6 * price_in + held / 1e6 * price_cached + F.coalesce(output, F.lit(0)) / 1e6 * price_out
    return F.when(input_tokens.isNotNull() | output.isNotNull(), total)


def priced(rows: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """rows with the prices (a million tokens: price_in, price_cached, price_out) of their models. A model without prices is an error."""
    known = prices.select(F.col("model").alias("_model"), "price_in", "price_cached", "price_out")
    out = rows.join(known, F.col(model) == F.col("_model"), "left")
    missing = F.raise_error(F.concat(F.lit("no prices for "), F.coalesce(F.col(model), F.lit("null")))).cast("double")
    return out.select(*rows.columns, *[F.when(F.col("_model").isNull(), missing).otherwise(F.col(c)).alias(c) for c in ("price_in", "price_cached", "price_out")])
