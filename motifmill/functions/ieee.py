"""Floating-point columns that treat infinity and NaN as data.

Spark's ANSI mode raises on x / 0 and ln(0) is null; scores need inf, -inf and NaN instead, and
sort NaN last in either direction.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Plain numbers: columns can only be made while a session lives.
NAN, INF = float("nan"), float("inf")


def div(n: Column, d: Column) -> Column:
    """n / d: x/0 is signed infinity, 0/0 and NaN/x are NaN; null where either is."""
    n, d = n.cast("double"), d.cast("double")
    return F.when(n.isNull() | d.isNull(), F.lit(None).cast("double")).when(d != 0, n / d).when(F.isnan(n) | (n == 0), F.lit(NAN)).when(n > 0, F.lit(INF)).when(n < 0, F.lit(-INF))


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < INF)


def nan_to_num(x: Column, nan: float = 0.0, inf: float = 0.0) -> Column:
    """NaN and infinities replaced."""
    return F.when(F.isnan(x), F.lit(nan)).when(F.abs(x) == INF, F.lit(inf)).otherwise(x)


def log(x: Column) -> Column:
    """Natural logarithm with log(0) = -inf and NaN below zero."""
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(-INF)).otherwise(F.lit(NAN))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def nan_last(name: str, ascending: bool = False) -> Column:
    """A sort key with NaN after every number."""
    key = F.when(~F.isnan(name), F.col(name))
    return key.asc_nulls_last() if ascending else key.desc_nulls_last()
