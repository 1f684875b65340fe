"""Integrals of spectra over frequency."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumachron.functions.numeric import TAU, is_finite
from lumachron.operators.blocks import same, written


def trapezoid(spectrum: DataFrame, keys: list[str], value: Column, count: int, step: float, name: str = "integral") -> DataFrame:
    """Integral by the trapezoid rule on the whole grid: end points count half, so it is a weighted sum and needs no order."""
    weight = F.when(F.col("freq_id").isin(1, count), F.lit(0.5)).otherwise(F.lit(1.0))
    return spectrum.groupBy(*keys).agg((F.sum(weight * value) * F.lit(step)).alias(name))


def trapezoid_of_points(points: DataFrame, keys: list[str], x: str, y: str, name: str = "integral") -> DataFrame:
    """The same for unevenly spaced points."""
    w = Window.partitionBy(*keys).orderBy(x)
    area = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return points.withColumn("area", area).groupBy(*keys).agg(F.sum("area").alias(name))


#: Fixed values of the 21-point Gauss-Kronrod rule on [-1, 1]: nodes from 0 up, Kronrod weights, and the weights of the
#: 10-point Gauss rule at its own nodes (every second one).
NODES = [0.0, 0.148874338981631211, 0.294392862701460198, 0.433395394129247191, 0.562757134668604683, 0.679409568299024406, 0.780817726586416897, 0.865063366688984511, 0.930157491355708226, 0.973906528517171720, 0.995657163025808081]
KRONROD = [0.149445554002916906, 0.147739104901338491, 0.142775938577060081, 0.134709217311473326, 0.123491976262065851, 0.109387158802297642, 0.093125454583697606, 0.075039674810919953, 0.054755896574351996, 0.032558162307964727, 0.011694638867371874]
GAUSS = [0.0, 0.295524224714752870, 0.0, 0.269266719309996355, 0.0, 0.219086362515982044, 0.0, 0.149451349150580593, 0.0, 0.066671344308688138, 0.0]


def adaptive(spark: SparkSession, low: float, high: float, evaluate: Callable[[list[tuple[int, int, float]]], DataFrame], tolerance: float = 1e-8, rounds: int = 12, start: int = 8) -> DataFrame:
    """key, integral, error of evaluate(nodes) over [low, high]: intervals whose two rules differ too much are halved.

    evaluate takes a list of (interval, node, f) and returns (key, interval, node, y) for each key; all open intervals of a round
    are one job, whose sums by key are written; the driver sees which intervals are open alone. An interval is halved until its share of
    the tolerance is met for every key, or the rounds are over; what is left counts as it is, its error in the error.
    """
    open_, parts = [(low + (high - low) * k / start, low + (high - low) * (k + 1) / start) for k in range(start)], []
    rule = [(s * x, k, g) for x, k, g in zip(NODES, KRONROD, GAUSS) for s in ((1, -1) if x else (1,))]
    for attempt in range(rounds):
        rows = [(i, j, a + (b - a) * (1 + x) / 2, k * (b - a) / 2, g * (b - a) / 2) for i, (a, b) in enumerate(open_) for j, (x, k, g) in enumerate(rule)]
        nodes = spark.createDataFrame(rows, "interval int, node int, f double, kronrod double, gauss double")
        values = evaluate([r[:3] for r in rows]).join(F.broadcast(nodes.drop("f")), ["interval", "node"])
        sums = written(values.groupBy("key", "interval").agg(F.sum(F.col("y") * F.col("kronrod")).alias("k"), F.sum(F.col("y") * F.col("gauss")).alias("g")), "sums")
        share = tolerance / (start * 2**attempt)
        bad = sorted(r["interval"] for r in sums.where(F.abs(F.col("k") - F.col("g")) > share).select("interval").distinct().collect()) if attempt + 1 < rounds else []
        parts.append(sums.where(~F.col("interval").isin(bad)) if bad else sums)
        open_ = [half for i in bad for a, b in [open_[i]] for half in ((a, (a + b) / 2), ((a + b) / 2, b))]
        if not open_:
            break
    return reduce(DataFrame.union, parts).groupBy("key").agg(F.sum("k").alias("integral"), F.sum(F.abs(F.col("k") - F.col("g"))).alias("error"))


def with_ladder(attempts: list[Callable[[DataFrame | None], DataFrame]], limit: float, fallback: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """key, integral, error, way: of each key the first attempt whose integral is finite with an error within the limit, else the
    fallback; way counts the attempts before. Each is called with the keys that are still open (None: all)."""
    open_, done = None, []
    for way, attempt in enumerate(attempts):
        found = written(attempt(open_), "attempt").withColumn("way", F.lit(way))
        good = F.coalesce(is_finite(F.col("integral")) & (F.col("error") <= limit), F.lit(False))
        done.append(found.where(good))
        open_ = written(found.where(~good).select("key"), "open")
        if open_.isEmpty():
            return reduce(DataFrame.union, done)
    return reduce(DataFrame.union, [*done, fallback(open_).withColumn("way", F.lit(len(attempts)))])


def power_at(sums_at: DataFrame) -> DataFrame:
    """key, interval, node, y: standardised power of each series at the nodes, from moments keyed by interval and node."""
    return sums_at.select(F.col("series_id").alias("key"), "interval", "node", (0.5 * (F.col("a") * F.col("a") + F.col("b") * F.col("b"))).alias("y"))


#: Distinct times of a block, and of them worked on at once; series whose sums a task holds before it hands them on.
BLOCK, TIMES, HELD = 8192, 2048, 16
SUMS = ["c1", "s1", "c2", "s2", "xc", "xs"]


def at_times(series: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks (series_id, block, t, n, x) of distinct times in arrays, with how many observations each has and the sum of their values; and n, mean and
    deviation of each series. Both written once, and read for any number of frequencies."""
    rows = series.select("series_id", F.col("t").cast("double").alias("t"), F.col("x").cast("double").alias("x"))
    stats = written(rows.groupBy("series_id").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd")), "stats")
    times = written(rows.groupBy("series_id", "t").agg(F.count("*").cast("double").alias("n"), F.sum("x").alias("x")), "times")
    counts = times.groupBy("series_id").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = same(times, counts, ["series_id"]).withColumn("block", F.pmod(F.xxhash64("t"), F.col("blocks")))
    cores = series.sparkSession.sparkContext.defaultParallelism
    blocks = dealt.repartition(cores, "series_id", "block").groupBy("series_id", "block").agg(F.collect_list(F.struct("t", "n", "x")).alias("o"))  # bounded by a block
    return written(blocks.select("series_id", "block", "o.t", "o.n", "o.x"), "times"), stats


def product_sums(blocks: DataFrame, base: np.ndarray, offset: np.ndarray) -> DataFrame:
    """series_id, k and the six sums of each series at the frequencies base_i + offset_j, k = i len(offset) + j.

    Waves of base and offset are made apart, and all sums are products of the two matrices, so a time costs as many waves as there are bases and offsets."""
    base, offset = np.asarray(base, np.float64), np.asarray(offset, np.float64)
    total = len(base) * len(offset)

    def added(t: np.ndarray, n: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros((6, len(base), len(offset)))
        for a in range(0, len(t), TIMES):
            own = slice(a, a + TIMES)
            few = np.exp(1j * TAU * np.outer(t[own], offset))
            for b in range(0, len(base), TIMES):
                many = np.exp(1j * TAU * np.outer(base[b : b + TIMES], t[own]))
                for c, z in enumerate(((many * n[own]) @ few, (many * many * n[own]) @ (few * few), (many * x[own]) @ few)):
                    out[2 * c, b : b + TIMES] += z.real
                    out[2 * c + 1, b : b + TIMES] += z.imag
        return out.reshape(6, total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, np.ndarray] = {}
        kind = pa.null()

        def handed(key: object, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, total, 10_000):
                k = np.arange(a, min(total, a + 10_000), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(k), kind), pa.array(k), *map(pa.array, sums[:, k])], ["series_id", "k", *SUMS])

        for batch in batches:
            kind = batch.column(0).type
            for r in range(batch.num_rows):
                key, sums = batch.column(0)[r].as_py(), added(*(np.asarray(batch.column(c)[r].values) for c in (1, 2, 3)))
                held[key] = held[key] + sums if key in held else sums
                if len(held) > HELD:
                    for k in list(held):
                        yield from handed(k, held.pop(k))
        for key, sums in held.items():
            yield from handed(key, sums)

    kind = dict(blocks.dtypes)["series_id"]
    found = blocks.select("series_id", "t", "n", "x").mapInArrow(run, f"series_id {kind}, k int, " + ", ".join(f"{c} double" for c in SUMS))
    return found.groupBy("series_id", "k").agg(*[F.sum(c).alias(c) for c in SUMS])


def node_sums(blocks: DataFrame, stats: DataFrame, nodes: list[tuple[int, int, float]]) -> DataFrame:
    """Moments of each series of `at_times` at the frequencies of (interval, node, f) tuples. Intervals whose nodes lie alike are one matrix product."""
    f = np.array([f for _, _, f in nodes])
    base, offset = f, np.zeros(1)
    wide = next((k for k, x in enumerate(nodes) if x[0] != nodes[0][0]), len(nodes))
    if len(nodes) % wide == 0:
        table = f.reshape(-1, wide)
        if np.abs(table - table[:, :1] - (table[0] - table[0, 0])).max() <= 1e-15 * np.abs(f).max():
            base, offset = table[:, 0], table[0] - table[0, 0]
    names = blocks.sparkSession.createDataFrame([(k, *x) for k, x in enumerate(nodes)], "k int, interval int, node int, f double")
    sums = same(product_sums(blocks, base, offset).join(F.broadcast(names), "k"), stats, ["series_id"])
    return sums.withColumn("omega", F.lit(TAU) * F.col("f")).drop("k", "f")


def node_moments(series: DataFrame, nodes: list[tuple[int, int, float]]) -> DataFrame:
    """Moments of each series at the frequencies of (interval, node, f) tuples."""
    return node_sums(*at_times(series), nodes)


def even_moments(blocks: DataFrame, stats: DataFrame, count: int, step: float, start: float) -> DataFrame:
    """Moments of each series of `at_times` at start, start + step, ... (freq_id from 1 to count)."""
    run = math.ceil(math.sqrt(count))
    sums = product_sums(blocks, start + np.arange(-(-count // run)) * run * step, np.arange(run) * step).where(F.col("k") < count)
    rows = same(sums.withColumn("freq_id", F.col("k") + 1).drop("k"), stats, ["series_id"])
    f = F.lit(start) + (F.col("freq_id") - 1) * F.lit(step)
    return rows.withColumn("f", f).withColumn("omega", F.lit(TAU) * f)
