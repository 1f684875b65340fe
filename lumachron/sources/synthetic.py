"""Made-up series: irregular times and noisy sines, from seeds, as large as asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumachron.functions.numeric import TAU

#: Observations that a block of running sums has.
BLOCK = 100_000


def irregular_times(spark: SparkSession, series: int, n: int, seed: int = 0, mean: float = 15.0, long_mean: float = 1.0, long_share: float = 0.15, block: int = BLOCK) -> DataFrame:
    """series_id, row_id, t: times whose gaps are exponential, with one mean or, for a share of them, another. Sums run within blocks; of
    each block only its total meets the others."""
    rows = spark.range(series * n).select(F.floor(F.col("id") / n).cast("string").alias("series_id"), (F.col("id") % n).alias("row_id"))
    chance = lambda k: (F.pmod(F.xxhash64(F.lit(seed + k), "series_id", "row_id"), F.lit(1 << 40)) + 0.5) / (1 << 40)
    gap = -F.log(chance(0)) * F.when(chance(1) < long_share, F.lit(long_mean)).otherwise(F.lit(mean))
    rows = rows.select("series_id", "row_id", gap.alias("gap"), F.floor(F.col("row_id") / block).alias("block"))
    totals = rows.groupBy("series_id", "block").agg(F.sum("gap").alias("total"))
    before = totals.select("series_id", "block", (F.sum("total").over(Window.partitionBy("series_id").orderBy("block")) - F.col("total")).alias("before"))
    inner = F.sum("gap").over(Window.partitionBy("series_id", "block").orderBy("row_id"))
    return rows.withColumn("upto", inner).join(before, ["series_id", "block"]).select("series_id", "row_id", (F.col("before") + F.col("upto")).alias("t"))


def sines(times: DataFrame, frequency: float, noise: float, seed: int = 0) -> DataFrame:
    """times with x: a sine of the frequency plus normal noise, which depends on seed, series and row alone."""
    chance = lambda k: (F.pmod(F.xxhash64(F.lit(seed + k), F.lit("noise"), "series_id", "row_id"), F.lit(1 << 40)) + 0.5) / (1 << 40)
    normal = F.sqrt(-2 * F.log(chance(0))) * F.cos(F.lit(TAU) * chance(1))
    return times.withColumn("x", F.sin(F.lit(TAU * frequency) * F.col("t")) + F.lit(noise) * normal)
