"""Trigonometric moments of series on a frequency grid, and the two components that all spectra are made of.

For each series and frequency, sums of cos and sin of wt and 2wt and of x times them suffice: the phase shift tau, the mean and the
deviation enter afterwards, so one aggregate with partial sums does for any number of spectra and pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumachron.functions.numeric import TAU, ieee_div

#: Frequencies are k * STEP cycles a day, k = 1 to COUNT.
STEP, COUNT = 0.001, 200


def frequency(step: float, start: float | None = None) -> Column:
    """The frequency of freq_id: its number of steps, or, counted from 1, that many steps less one from the start."""
    return F.col("freq_id") * F.lit(step) if start is None else F.lit(start) + (F.col("freq_id") - 1) * F.lit(step)


def with_grid(df: DataFrame, count: int = COUNT, step: float = STEP, variable: str = "f", start: float | None = None) -> DataFrame:
    """df with every frequency: freq_id, f, omega. variable "omega": the grid's values are taken as omega itself."""
    f = frequency(step, start)
    rows = df.withColumn("freq_id", F.explode(F.sequence(F.lit(1), F.lit(count))))
    return rows.withColumn("f", f).withColumn("omega", f if variable == "omega" else F.lit(TAU) * f)


def with_own_grid(df: DataFrame, step: float = STEP, block: int = 100_000) -> DataFrame:
    """df with every frequency from the step to the row's own f_max: freq_id, f, omega. Rows whose f_max isn't finite fail.

    Frequencies come in blocks of indices, dealt over all tasks, as a high f_max makes many of a row."""
    limit = F.when(F.isnan("f_max") | (F.col("f_max") == float("inf")), F.raise_error(F.lit("f_max is not finite")).cast("double")).otherwise(F.col("f_max"))
    last = F.floor(limit / F.lit(step)).cast("long") + 1  # one more, as the quotient may round down; the filter decides
    blocks = df.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / block))))
    blocks = blocks.repartition(*df.columns, "part") if not df.isStreaming else blocks
    ids = F.sequence(F.greatest(F.col("part") * block, F.lit(1).cast("long")), F.least(F.col("part") * block + (block - 1), last))
    rows = blocks.where(F.greatest(F.col("part") * block, F.lit(1)) <= last).withColumn("freq_id", F.explode(ids)).drop("part")
    f = F.col("freq_id") * F.lit(step)
    return rows.withColumn("f", f).where("f <= f_max").withColumn("omega", F.lit(TAU) * F.col("f"))


def sampling(series: DataFrame) -> DataFrame:
    """n, first and last time, mean, deviation, mean step (range over n) and pseudo-Nyquist frequency of each series."""
    stats = series.groupBy("series_id").agg(F.count("*").alias("n"), F.min("t").alias("t_min"), F.max("t").alias("t_max"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
    delta = (F.col("t_max") - F.col("t_min")) / F.col("n")
    return stats.withColumn("delta_t", delta).withColumn("f_max", ieee_div(F.lit(1.0), 2 * F.col("delta_t")))


def sums_of(c: str, s: str) -> list[Column]:
    """The aggregates, from x and the columns of cos wt and sin wt."""
    c, s, x = F.col(c), F.col(s), F.col("x")
    return [
        F.count("*").alias("n"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("sd"),
        F.sum(c).alias("c1"),
        F.sum(s).alias("s1"),
        F.sum(2 * c * c - 1).alias("c2"),
        F.sum(2 * c * s).alias("s2"),
        F.sum(x * c).alias("xc"),
        F.sum(x * s).alias("xs"),
    ]


def spread(series: DataFrame) -> DataFrame:
    """series over all cores where it comes in fewer files: each row is about to make `count` rows, so moving it is little."""
    cores = series.sparkSession.sparkContext.defaultParallelism
    return series if series.isStreaming or len(series.inputFiles()) >= cores else series.repartition(cores)


def moments(series: DataFrame, count: int = COUNT, step: float = STEP, variable: str = "f", keys: tuple[str, ...] = ("series_id",), start: float | None = None) -> DataFrame:
    """Sums by series (or other keys) and frequency."""
    rows = with_grid(spread(series.select(*keys, "t", "x")), count, step, variable, start)
    rows = rows.select(*keys, "freq_id", "x", F.cos(F.col("omega") * F.col("t")).alias("c"), F.sin(F.col("omega") * F.col("t")).alias("s"))
    sums = rows.groupBy(*keys, "freq_id").agg(*sums_of("c", "s"))
    f = frequency(step, start)
    return sums.withColumn("f", f).withColumn("omega", f if variable == "omega" else F.lit(TAU) * f)


def shift(mode: str = "compat") -> Column:
    """tau. compat: atan of the ratio over 2 pi, so results depend on the unit and origin of time; paper: atan2 over 2 omega."""
    if mode == "paper":
        return F.atan2("s2", "c2") / (2 * F.col("omega"))
    return F.atan(ieee_div(F.col("s2"), F.col("c2"))) / F.lit(TAU)


def components(sums: DataFrame, demean: bool = True, standardise: bool = True, mode: str = "compat") -> DataFrame:
    """sums with tau, a and b (cosine and sine components), p_cos and p_sin (those of the phase, times after tau)."""
    mean = F.col("mean") if demean else F.lit(0.0)
    sd = F.when(F.col("sd").isNull(), F.lit(float("nan"))).otherwise(F.col("sd")) if standardise else F.lit(1.0)
    rows = sums.withColumn("tau", shift(mode))
    yc, ys = ieee_div(F.col("xc") - mean * F.col("c1"), sd), ieee_div(F.col("xs") - mean * F.col("s1"), sd)
    angle = F.col("omega") * F.col("tau")
    spread = F.cos(2 * angle) * F.col("c2") + F.sin(2 * angle) * F.col("s2")
    rows = rows.select("*", yc.alias("yc"), ys.alias("ys"), F.cos(angle).alias("ct"), F.sin(angle).alias("st"), F.greatest((F.col("n") + spread) / 2, F.lit(0.0)).alias("dc"), F.greatest((F.col("n") - spread) / 2, F.lit(0.0)).alias("ds"))
    p, q = F.col("ct") * F.col("yc") + F.col("st") * F.col("ys"), F.col("st") * F.col("yc") - F.col("ct") * F.col("ys")
    rows = rows.select("*", ieee_div(p, F.sqrt("dc")).alias("a"), ieee_div(q, F.sqrt("ds")).alias("b"), ieee_div(p, F.col("dc")).alias("p_cos"), ieee_div(-q, F.col("ds")).alias("p_sin"))
    return rows.drop("yc", "ys", "ct", "st", "dc", "ds")
