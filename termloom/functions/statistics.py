"""p-values as column expressions, so that every group of an aggregation gets its own without a call to Python."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .identity import let

#: Steps of the continued fraction and of the series, which meet at SPLIT; least argument of Stirling's series.
FRACTION, SERIES, SPLIT, SHIFT = 120, 60, 2.0, 9


def number(x: float) -> Column:
    return F.lit(float(x))


def erfc(x: Column) -> Column:
    """The complementary error function of x >= 0: a series of erf below 2, a continued fraction from there."""

    def of(v: Column) -> Column:
        square = F.exp(-v * v)
        # 2 / sqrt(pi) * exp(-x^2) * sum of 2^n x^(2n+1) / (2n+1)!!
        step = lambda a, n: F.struct((a.sum + a.term).alias("sum"), (a.term * 2 * v * v / (2 * n + 3)).alias("term"))
        small = F.aggregate(F.sequence(F.lit(0), F.lit(SERIES - 1)), F.struct(number(0).alias("sum"), v.alias("term")), step, lambda a: a.sum)
        large = F.aggregate(F.sequence(F.lit(FRACTION), F.lit(1)), v, lambda f, k: v + k / 2 / f)
        return F.when(v < SPLIT, 1 - 2 / math.sqrt(math.pi) * square * small).otherwise(square / math.sqrt(math.pi) / large)

    return let(x.cast("double"), of)


def p_value(z: Column) -> Column:
    """Two-sided, of a standard normal statistic; null for null."""
    return erfc(F.abs(z.cast("double")) / math.sqrt(2))


def log_factorial(n: Column) -> Column:
    """ln n! of a whole number that isn't negative, by Stirling's series from n + SHIFT on."""

    def of(x: Column) -> Column:  # x = n + 1
        far = x + SHIFT
        passed = F.aggregate(F.sequence(F.lit(0), F.lit(SHIFT - 1)), number(0), lambda a, k: a + F.log(x + k))
        series = 1 / (12 * far) - 1 / (360 * F.pow(far, F.lit(3))) + 1 / (1260 * F.pow(far, F.lit(5))) - 1 / (1680 * F.pow(far, F.lit(7)))
        return (far - 0.5) * F.log(far) - far + 0.5 * math.log(2 * math.pi) + series - passed

    return let(n.cast("double") + 1, of)


def mcnemar(b: Column, c: Column) -> Column:
    """The exact two-sided p of b and c discordant pairs, the binomial tail up to the smaller; 1 without any. The tail is summed from its largest term down, as far as
    terms count (ten deviations)."""
    parts = F.struct((b + c).cast("double").alias("n"), F.least(b, c).cast("double").alias("k"))

    def of(v: Column) -> Column:
        largest = log_factorial(v.n) - log_factorial(v.k) - log_factorial(v.n - v.k) - v.n * math.log(2)
        last = F.greatest(F.lit(0), F.least(v.k, 10 * F.sqrt(v.n) + 100).cast("int") - 1)
        step = lambda a, i: F.struct((a.sum + a.term).alias("sum"), (a.term * F.greatest(v.k - i, number(0)) / (v.n - v.k + i + 1)).alias("term"))
        # the terms below the largest, as parts of it
        tail = F.aggregate(F.sequence(F.lit(0), last), F.struct(number(0).alias("sum"), number(1).alias("term")), step, lambda a: a.sum + a.term)
        return F.when(v.n > 0, F.least(number(1), F.exp(largest + F.log(2 * tail)))).when(v.n == 0, 1.0)

    return let(parts, of)
