"""Rounding rules that displayed numbers depend on."""

from pyspark.sql import Column, functions as F


def round_half_up(x: Column) -> Column:
    """Half toward plus infinity, also for negative numbers."""
    return F.floor(x + F.lit(0.5))


def percent(x: Column) -> Column:
    return round_half_up(x * F.lit(100.0))


def round_half_even(x: Column) -> Column:
    return F.bround(x).cast("bigint")


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def tenths_text(x: Column) -> Column:
    """A number >= 0 with one decimal, rounded on its exact binary value, ties to even.

    The remainder ``20 x - (2 k + 1)`` is formed in two steps that are both exact near a tie.
    """
    k = F.floor(x * 10)
    middle = 2 * k + 1
    rest = (16 * x - middle) + 4 * x
    tenths = F.when(rest > 0, k + 1).when(rest < 0, k).otherwise(k + k % 2)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def mean(x: Column) -> Column:
    """The average at 12 decimals: the same whatever order the parts were summed in."""
    return F.round(F.avg(x), 12)
