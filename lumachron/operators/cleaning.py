"""Cleaning and conversion of flux series: clipping, units, offsets, stitching."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumachron.functions.numeric import is_finite
from lumachron.operators.blocks import medians, same, written

#: Offsets in days of the missions' time scales.
OFFSETS = {"Kepler": 2454833.0, "TESS": 2457000.0}


def positive_clip(series: DataFrame) -> DataFrame:
    """Values that aren't positive and finite become the least positive one of their series; fails if a series has none."""
    good = is_finite(F.col("x")) & (F.col("x") > 0)
    least = series.groupBy("series_id").agg(F.min(F.when(good, F.col("x"))).alias("least"))
    checked = F.when(F.col("least").isNull(), F.raise_error(F.concat(F.lit("no positive value: "), F.coalesce(F.col("series_id").cast("string"), F.lit("null")))).cast("double")).otherwise(F.col("least"))
    return same(series, least, ["series_id"]).withColumn("x", F.when(good, F.col("x")).otherwise(checked)).drop("least")


def sigma_clip(series: DataFrame, sigma: float = 8.0, iterations: int = 5) -> DataFrame:
    """Values farther than sigma deviations from their series' median go, again and again up to `iterations` times."""
    for _ in range(iterations):
        spread = series.groupBy("series_id").agg(F.stddev_pop("x").alias("spread"))
        limits = written(same(medians(series, ("series_id",), "x"), spread, ["series_id"]), "limits")
        if iterations > 2:  # stop where nothing is left to drop
            far = F.abs(F.col("x") - F.col("middle")) <= sigma * F.col("spread")
            if same(series, limits, ["series_id"]).where(~F.coalesce(far, F.lit(False))).isEmpty():
                break
        series = same(series, limits, ["series_id"]).where(F.abs(F.col("x") - F.col("middle")) <= sigma * F.col("spread")).drop("middle", "spread")
    return series


def magnitudes(series: DataFrame) -> DataFrame:
    """mag = -2.5 log10(x / median), and mag_err = 2.5 / ln 10 * x_err / x; errors that aren't positive and finite are null."""
    middle = medians(series, ("series_id",), "x")
    mag = -2.5 * F.log10(F.col("x") / F.col("middle"))
    rows = same(series, middle, ["series_id"]).withColumn("mag", mag).drop("middle")
    if "x_err" not in series.columns:
        return rows.withColumn("mag_err", F.lit(None).cast("double"))
    error = F.when(is_finite(F.col("x_err")) & (F.col("x_err") > 0), F.col("x_err"))
    return rows.withColumn("mag_err", F.lit(2.5 / math.log(10)) * error / F.col("x"))


def absolute_time(series: DataFrame, offset: float, mode: str = "auto") -> DataFrame:
    """Times plus the mission's offset: always ("force"), never ("raw"), or if the series' median time is below 1e5 ("auto")."""
    if mode not in ("auto", "force", "raw"):
        raise ValueError("mode must be auto, force or raw")
    if mode != "auto":
        return series.withColumn("t", F.col("t") + F.lit(offset if mode == "force" else 0.0))
    middle = medians(series, ("series_id",), "t")
    return same(series, middle, ["series_id"]).withColumn("t", F.when(F.col("middle") < 1e5, F.col("t") + offset).otherwise(F.col("t"))).drop("middle")


def stitched(segments: DataFrame) -> DataFrame:
    """Segments (series_id, segment, t, x), each divided by its median, as one series."""
    middle = medians(segments, ("series_id", "segment"), "x")
    return same(segments, middle, ["series_id", "segment"]).withColumn("x", F.col("x") / F.col("middle")).drop("middle")


def label_consensus(label: str) -> Column:
    """The label that all rows of a group have, or MIXED_FLUX; an aggregate. Rows without a label don't count; without any label it is MIXED_FLUX."""
    return F.when(F.count_distinct(F.col(label)) == 1, F.min(label)).otherwise(F.lit("MIXED_FLUX"))


def choose_flux(df: DataFrame, preferred: tuple[str, ...] = ("pdcsap_flux", "sap_flux", "flux")) -> DataFrame:
    """df with x and flux_label from the first preferred column that its schema has."""
    name = next((c for c in preferred if c in df.columns), None)
    if name is None:
        raise KeyError(f"none of {preferred} in {df.columns}")
    return df.withColumn("x", F.col(name).cast("double")).withColumn("flux_label", F.lit(name.upper()))


def mission_offset(mission: str) -> float:
    """The offset of a mission's time scale; other missions are refused."""
    if mission.strip() not in OFFSETS:
        raise ValueError(f"mission must be one of {', '.join(OFFSETS)}")
    return OFFSETS[mission.strip()]


def guarded(series: DataFrame, expected: DataFrame) -> DataFrame:
    """series, failing if one of the expected (series_id) has no observation."""
    counts = expected.select("series_id").distinct().join(series.groupBy("series_id").agg(F.count("*").alias("n")), "series_id", "left")
    checked = counts.select("series_id", F.when(F.col("n").isNull(), F.raise_error(F.concat(F.lit("empty series: "), F.col("series_id"))).cast("boolean")).otherwise(F.lit(True)).alias("checked"))
    return series.join(checked, "series_id", "left").where(F.coalesce("checked", F.lit(True))).drop("checked")


def light_curves(flux: DataFrame, mission: str = "Kepler", sigma: float = 8.0, iterations: int = 5, mode: str = "auto", errors: bool = True) -> DataFrame:
    """series_id, time, mag, mag_err, flux_label of mission light curves (series_id, segment, t, columns of flux, x_err if known).

    The flux column is chosen, its NaN go, segments are stitched by their medians (errors too), outliers go, times become absolute,
    values that aren't positive become the least positive one, and magnitudes are those of the median. An error that isn't
    positive and finite is NaN, if errors are known; without errors the column is null. Other columns are kept.
    """
    offset = mission_offset(mission)
    series = choose_flux(flux).where(F.col("x").isNotNull() & ~F.isnan("x"))
    known = errors and "x_err" in flux.columns
    middle = medians(series, ("series_id", "segment"), "x")
    series = same(series, middle, ["series_id", "segment"]).withColumn("x", F.col("x") / F.col("middle"))
    series = series.withColumn("x_err", F.col("x_err") / F.col("middle") if known else F.lit(None).cast("double")).drop("middle")
    clipped = written(sigma_clip(written(series, "stitched"), sigma, iterations), "clipped")  # each is read several times
    rows = magnitudes(positive_clip(absolute_time(clipped, offset, mode))).withColumnRenamed("t", "time")
    return rows.withColumn("mag_err", F.coalesce("mag_err", F.lit(float("nan")))) if known else rows


def prefixes(series: DataFrame, lengths: list[int]) -> DataFrame:
    """The first n observations of each series for each n of a few short lengths, keyed by series_id and length; `operators.prefixes` has all lengths
    at once. Each task keeps its own first rows before any move."""
    order = Window.partitionBy("series_id").orderBy("t", "row_id")
    ranked = series.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(lengths))
    return ranked.withColumn("length", F.explode(F.array(*[F.lit(n) for n in lengths]))).where(F.col("rank") <= F.col("length")).drop("rank")


def sampled(series: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k random rows of each series, or all if it has fewer: those of the least hashes of seed and row_id. The k least of parts are among the k least
    of each part, so tasks keep k rows before any move, and the sample doesn't depend on how rows lie; the sample of a union is
    drawn from the samples. Ties by row_id."""
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("row_id").cast("string")))
    order = Window.partitionBy("series_id").orderBy(hashed, "row_id")
    return series.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")
