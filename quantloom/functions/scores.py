"""Linear 0-100 scores; null stays null, degenerate bounds give 50."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """x within bounds; null stays null (``greatest`` alone would skip it), NaN counts as null."""
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def clip_score(x: Column, default: float = 0.0) -> Column:
    return F.coalesce(clip(x), F.lit(default))


def higher(x: Column, low: float, high: float) -> Column:
    if low == high:
        return F.when(x.isNotNull(), F.lit(50.0))
    return clip((x - low) / (high - low) * 100)


def lower(x: Column, low: float, high: float) -> Column:
    if low == high:
        return F.when(x.isNotNull(), F.lit(50.0))
    return clip((high - x) / (high - low) * 100)


def center(x: Column, middle: float, tolerance: float) -> Column:
    if tolerance <= 0:
        return F.when(x.isNotNull(), F.lit(50.0))
    return clip((1 - F.abs(x - middle) / tolerance) * 100)


def average_available(*parts: Column, default: float = 50.0) -> Column:
    """Mean of the parts that are not null, ``default`` if none is."""
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    n = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    return F.when(n > 0, total / n).otherwise(F.lit(default))
