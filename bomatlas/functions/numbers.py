"""Arithmetic with the rounding rules the published figures use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(value: Column, digits: int = 2) -> Column:
    """``floor(x * 10^d + 0.5) / 10^d``, on binary doubles.

    Spark's ``round`` goes through decimals and gives other answers for values such
    as 1.005.
    """
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def rate_pct(part: Column, total: Column) -> Column:
    """``part / total * 100``; 0 for an empty total."""
    return F.when(
        total > 0, part.cast("double") / total.cast("double") * F.lit(100.0)
    ).otherwise(F.lit(0.0))


def overlap_pct(shared: Column, union: Column) -> Column:
    """Share of the union in per cent with one decimal, rounded half up; 0 if empty."""
    return F.when(
        union > 0,
        F.floor(shared.cast("double") / union.cast("double") * F.lit(1000.0) + F.lit(0.5)).cast(
            "double"
        )
        / F.lit(10.0),
    ).otherwise(F.lit(0.0))
