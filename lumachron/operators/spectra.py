"""Spectra of one series and of pairs, as expressions over components."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumachron.functions.numeric import TAU, ieee_div


def power() -> Column:
    """Half the sum of the squared components; the amplitude spectrum is the same quantity."""
    return 0.5 * (F.col("a") * F.col("a") + F.col("b") * F.col("b"))


def phase() -> Column:
    return F.pmod(F.atan2(-F.col("p_sin"), F.col("p_cos")), F.lit(TAU))


def pairs(parts: DataFrame, *columns: str, both_ways: bool = False, across: Column | None = None) -> DataFrame:
    """Components of all pairs of series at each frequency, as column1 and column2; joined on the frequency. across: which pairs
    are wanted, in place of those of different series."""
    side = lambda k: parts.select("freq_id", "f", "omega", F.col("series_id").alias(f"series{k}"), *[F.col(c).alias(f"{c}{k}") for c in columns or ("a", "b")])
    joined = side(1).join(side(2).drop("f", "omega"), "freq_id")
    return joined.where(across if across is not None else F.expr("series1 <> series2" if both_ways else "series1 < series2"))


def cospectrum() -> Column:
    return 0.5 * (F.col("a1") * F.col("a2") + F.col("b1") * F.col("b2"))


def quadrature() -> Column:
    return 0.5 * (F.col("a1") * F.col("b2") - F.col("b1") * F.col("a2"))


def cross_amplitude() -> Column:
    """Squares of the spectra without the halves, summed, no root taken."""
    return 4 * (cospectrum() * cospectrum() + quadrature() * quadrature())


def cross_phase(fixed: bool = False) -> Column:
    """Angle of the cross spectrum: modulo 2 and then times pi, as the original has it, or modulo 2 pi."""
    angle = F.atan2(-2 * quadrature(), 2 * cospectrum())
    return F.pmod(angle, F.lit(TAU)) if fixed else F.pmod(angle, F.lit(2.0)) * F.lit(math.pi)


def squared_coherence() -> Column:
    """4 for all frequencies where both powers are positive, NaN elsewhere, as no smoothing takes place."""
    power_of = lambda k: 0.5 * (F.col(f"a{k}") * F.col(f"a{k}") + F.col(f"b{k}") * F.col(f"b{k}"))
    return ieee_div(cross_amplitude(), power_of(1) * power_of(2))


def fourier_sums(sums: DataFrame) -> DataFrame:
    """sums with u and v, the demeaned sums of x cos wt and x sin wt over n."""
    return sums.withColumn("u", (F.col("xc") - F.col("mean") * F.col("c1")) / F.col("n")).withColumn("v", (F.col("xs") - F.col("mean") * F.col("s1")) / F.col("n"))


def legacy_cross() -> tuple[Column, Column]:
    """Real and imaginary part of the mean of x1 x2 exp(-iw(t1 - t2)) over all pairs of observations: the product of two sums."""
    u1, v1, u2, v2 = (F.col(c) for c in ("u1", "v1", "u2", "v2"))
    return u1 * u2 + v1 * v2, u1 * v2 - v1 * u2
