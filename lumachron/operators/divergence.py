"""Jensen-type spectral divergence between series."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumachron.operators.blocks import written
from lumachron.operators.integrals import trapezoid
from lumachron.operators.tiles import pair_divergences
from lumachron.operators.transforms import band_components

ALPHA = 0.5
BETA = ALPHA * (1 - ALPHA)


def divergences(joined: DataFrame, keys: list[str], count: int, step: float) -> DataFrame:
    """Ix, Iy, Ixy and J = beta (Ix + Iy - 2 Ixy) / 2 pi of pairs joined on the frequency, on one band, in one aggregate."""
    half = lambda p, q: 0.5 * (F.col(f"a{p}") * F.col(f"a{q}") + F.col(f"b{p}") * F.col(f"b{q}"))
    weight = F.when(F.col("freq_id").isin(1, count), F.lit(0.5)).otherwise(F.lit(1.0)) * F.lit(step)
    sums = joined.groupBy(*keys).agg(F.sum(weight * half(1, 1)).alias("ix"), F.sum(weight * half(2, 2)).alias("iy"), F.sum(weight * half(1, 2)).alias("ixy"))
    return sums.withColumn("j", F.lit(BETA / (2 * math.pi)) * (F.col("ix") + F.col("iy") - 2 * F.col("ixy")))


def band_divergences(joined: DataFrame, bands: DataFrame, step: float) -> DataFrame:
    """The same with bands by series: Ix and Ixy up to the first series' limit, Iy up to the second's.

    bands has series_id and top, the last grid index of each series."""
    one, two = bands.select(F.col("series_id").alias("series1"), F.col("top").alias("top1")), bands.select(F.col("series_id").alias("series2"), F.col("top").alias("top2"))
    rows = joined.join(one, "series1").join(two, "series2")
    half = lambda p, q: 0.5 * (F.col(f"a{p}") * F.col(f"a{q}") + F.col(f"b{p}") * F.col(f"b{q}"))

    def weight(top: str):
        inside = F.when(F.col("freq_id").isin(1) | (F.col("freq_id") == F.col(top)), F.lit(0.5)).otherwise(F.lit(1.0))
        return F.when(F.col("freq_id") <= F.col(top), inside * F.lit(step)).otherwise(F.lit(0.0))

    sums = rows.groupBy("series1", "series2").agg(F.sum(weight("top1") * half(1, 1)).alias("ix"), F.sum(weight("top2") * half(2, 2)).alias("iy"), F.sum(weight("top1") * half(1, 2)).alias("ixy"))
    return sums.withColumn("j", F.lit(BETA / (2 * math.pi)) * (F.col("ix") + F.col("iy") - 2 * F.col("ixy")))


def band_tops(stats: DataFrame, step: float, strict: bool = True) -> DataFrame:
    """series_id, top, status: the last grid index of each series, the first that reaches its f_max. A series without one (a single observation, or
    all at one time) fails if strict, else has top 0 and the status "no band"."""
    none = F.isnan("f_max") | F.col("f_max").isNull() | (F.abs("f_max") == float("inf"))
    named = F.concat(F.lit("no band: "), F.coalesce(F.col("series_id").cast("string"), F.lit("null")))
    missing = F.raise_error(named).cast("double") if strict else F.lit(0.0)
    limit = F.when(none, missing).otherwise(F.col("f_max"))
    return stats.select("series_id", F.ceil(limit / F.lit(step)).cast("long").alias("top"), F.when(none, "no band").otherwise("").alias("status"))


def first_band_divergences(series: DataFrame, tops: DataFrame, step: float) -> DataFrame:
    """series1, series2, top, ix, iy, ixy, j of all ordered pairs, each on the band of its first series.

    Every series meets the highest band, so all have the fast transform up to it; pairs are products of tiles.
    """
    tops = written(tops.where("top > 0").select("series_id", "top"), "bands")
    highest = tops.agg(F.max("top")).first()[0] or 1
    parts = written(band_components(series, series.select("series_id").distinct().withColumn("top", F.lit(highest)), step), "components")
    every = series.select("series_id").distinct().join(tops, "series_id", "left").select("series_id", F.coalesce("top", F.lit(0)).alias("top"))
    found = pair_divergences(parts, every, step, both_ways=True)
    return found.join(tops.select(F.col("series_id").cast("string").alias("series1"), "top"), "series1").select("series1", "series2", "top", "ix", "iy", "ixy", "j")


def two_band_divergences(series: DataFrame, tops: DataFrame, step: float) -> DataFrame:
    """series1, series2, ix, iy, ixy, j of all ordered pairs with Ix and Ixy on the band of the first series and Iy on that of the second."""
    one = written(first_band_divergences(series, tops, step), "first-bands")
    own = one.groupBy(F.col("series1").alias("series2")).agg(F.first("ix").alias("own"))
    rows = one.join(own, "series2").withColumn("iy", F.col("own")).drop("own")
    return rows.select("series1", "series2", "ix", "iy", "ixy", (F.lit(BETA / (2 * math.pi)) * (F.col("ix") + F.col("iy") - 2 * F.col("ixy"))).alias("j"))


def nearest(matrix: DataFrame, k: int) -> DataFrame:
    """The k series of least divergence from each, from a matrix of unordered pairs (series1, series2, j)."""
    both = matrix.select("series1", "series2", "j").union(matrix.select("series2", "series1", "j"))
    order = Window.partitionBy("series1").orderBy("j", "series2")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def auto_integral(parts: DataFrame, count: int, step: float) -> DataFrame:
    """Integral of each series' auto-spectrum."""
    return trapezoid(parts, ["series_id"], 0.5 * (F.col("a") * F.col("a") + F.col("b") * F.col("b")), count, step)
