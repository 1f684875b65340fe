"""Spectra of growing prefixes of series: sums by steps of observations, and running sums over steps, so one pass gives all lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumachron.functions.numeric import TAU
from lumachron.operators.blocks import numbered, same, written
from lumachron.operators.divergence import divergences
from lumachron.operators.moments import COUNT, STEP, components, with_grid

SUMS = ["n", "sx", "sxx", "c1", "s1", "c2", "s2", "xc", "xs"]


def running_moments(series: DataFrame, first: int = 100, growth: int = 50, count: int = COUNT, step: float = STEP) -> DataFrame:
    """What `moments` gives, for the first `first` observations of each series, `growth` more, and so on to its last full step; keyed by series_id, length
    and freq_id.

    Each observation meets each frequency once; what is added up over steps is a row a series, step and frequency, as the result is. Values
    are taken from the series' mean, so that running squares keep their digits; a and b don't depend on it.
    """
    means = series.groupBy("series_id").agg(F.avg("x").alias("shift"))
    rows = same(numbered(series.select("series_id", "t", "x", "row_id")), means, ["series_id"]).where(F.col("i") <= F.col("n") - F.col("n") % growth)
    rows = rows.select("series_id", F.floor((F.col("i") - 1) / growth).alias("part"), "t", (F.col("x") - F.col("shift")).alias("x"))
    wide = with_grid(rows, count, step).select("series_id", "part", "freq_id", "x", F.cos(F.col("omega") * F.col("t")).alias("c"), F.sin(F.col("omega") * F.col("t")).alias("s"))
    c, s, x = F.col("c"), F.col("s"), F.col("x")
    each = dict(zip(SUMS, (F.lit(1), x, x * x, c, s, 2 * c * c - 1, 2 * c * s, x * c, x * s)))
    sums = wide.groupBy("series_id", "part", "freq_id").agg(*[F.sum(v).alias(k) for k, v in each.items()])
    upto = Window.partitionBy("series_id", "freq_id").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    run = sums.select("series_id", "freq_id", ((F.col("part") + 1) * growth).alias("length"), *[F.sum(k).over(upto).alias(k) for k in SUMS]).where(F.col("length") >= first)
    mean = F.col("sx") / F.col("n")
    f = F.col("freq_id") * F.lit(step)
    spread = F.sqrt(F.greatest(F.col("sxx") - F.col("sx") * mean, F.lit(0.0)) / F.when(F.col("n") > 1, F.col("n") - 1))
    return run.withColumns({"mean": mean, "sd": spread, "f": f, "omega": F.lit(TAU) * f}).drop("sx", "sxx")


def prefix_divergences(series: DataFrame, first: int = 100, growth: int = 50, count: int = COUNT, step: float = STEP) -> DataFrame:
    """series1, series2, length, ix, iy, ixy, j of all pairs, for every length that both series have."""
    parts = written(components(running_moments(series, first, growth, count, step)).select("series_id", "length", "freq_id", "a", "b"), "prefixes")
    side = lambda k: parts.select("length", "freq_id", F.col("series_id").alias(f"series{k}"), F.col("a").alias(f"a{k}"), F.col("b").alias(f"b{k}"))
    joined = side(1).join(side(2), ["length", "freq_id"]).where("series1 < series2")
    return divergences(joined, ["series1", "series2", "length"], count, step)
