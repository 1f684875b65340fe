"""Scalar expressions with the arithmetic that array languages use."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TAU = 2 * math.pi


def ieee_div(a: Column, b: Column) -> Column:
    """a / b where b may be 0: signed infinity, or NaN for 0 / 0."""
    inf = F.lit(float("inf"))
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).otherwise(F.signum(a) * inf)
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def epoch_days(ts: Column) -> Column:
    """Days since 1970 of a timestamp without time zone, to the microsecond; rounded twice, by seconds, as in the queries' SQL."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts) / F.lit(1e6) / F.lit(86400.0)


def rounded(c: Column, places: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, places) + F.lit(0.0)
