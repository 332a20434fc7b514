"""Windows of n rows per symbol that are null until n values are there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by() -> WindowSpec:
    """A symbol's rows in order of date."""
    return W.partitionBy("symbol").orderBy("date")


def so_far() -> WindowSpec:
    return by().rowsBetween(W.unboundedPreceding, 0)


def last_rows(n: int) -> WindowSpec:
    return by().rowsBetween(-(n - 1), 0)


def full(agg: Callable[[Column], Column], x: Column | str, n: int) -> Column:
    """``agg`` over the last n rows, null unless all n values are there."""
    x = F.col(x) if isinstance(x, str) else x
    over = last_rows(n)
    return F.when(F.count(x).over(over) == n, agg(x).over(over))


def sma(x: Column | str, n: int) -> Column:
    return full(F.avg, x, n)


def lag(x: Column | str, n: int = 1) -> Column:
    return F.lag(x, n).over(by())


def change(x: str, n: int = 1) -> Column:
    """x over its value n rows before, less 1."""
    return F.col(x) / lag(x, n) - 1


def guard(x: Column, eps: float = 1e-10) -> Column:
    """A denominator: 0 becomes ``eps``."""
    return F.when(x == 0, F.lit(eps)).otherwise(x)
