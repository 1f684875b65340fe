"""Adaptive integrals of spectra of many pairs of series at once, with a table of open intervals.

Each round works out all open intervals by the 21-point rule: frequencies that several pairs ask of a series are summed once. An interval
whose error is above its share of the pair's tolerance is split, for that pair alone; pairs whose errors add up to no
more than their tolerance are done. The driver sees how many intervals are open, nothing else. A pair that comes to its
limit of intervals goes on with the next attempt of the ladder, a wider tolerance and a higher limit, from the intervals
that it has; what no attempt settles is a trapezoid on a dense grid. Each pair ends with value, error, status, message, attempts
and the distinct messages of attempts that failed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumachron.functions.numeric import TAU, is_finite
from lumachron.operators.blocks import same, written
from lumachron.operators.integrals import GAUSS, KRONROD, NODES
from lumachron.operators.moments import components

#: Observations of a block.
BLOCK = 20_000
#: (tolerance, most intervals a pair) of the attempts: absolute, and relative to the value.
LADDER = ((1e-10, 500), (1e-8, 5_000), (1e-6, 20_000))
#: Points of the trapezoid that stands in at the end.
DENSE = 20_001
LIMIT, NOT_FINITE, STANDS_IN = "maximum number of subdivisions reached", "non-finite function value", "trapezoid on a dense grid"
RULE = [(s * x, k, g) for x, k, g in zip(NODES, KRONROD, GAUSS) for s in ((1, -1) if x else (1,))]
PAIR = ["series1", "series2", "kind"]
SUMS = ["c1", "s1", "c2", "s2", "xc", "xs"]


def packed(series: DataFrame) -> DataFrame:
    """series_id, block, t, x: observations in arrays of about BLOCK, written once, and read in every round."""
    counts = series.groupBy("series_id").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    rows = same(series.select("series_id", F.col("t").cast("double").alias("t"), F.col("x").cast("double").alias("x")), counts, ["series_id"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("t", "x", F.monotonically_increasing_id()), F.col("blocks")))
    return written(rows.groupBy("series_id", "block").agg(F.collect_list("t").alias("t"), F.collect_list("x").alias("x")), "packed")  # bounded by a block


def sums_at(blocks: DataFrame, asked: DataFrame) -> DataFrame:
    """series_id, low, high, node and the six sums at the rule's nodes of the asked intervals (series_id, low, high)."""
    places = np.array([x for x, _, _ in RULE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                t, x, low, high = (np.asarray(batch.column(c)[r].values) for c in range(1, 5))
                for a in range(0, len(low), 32):
                    lo, hi = low[a : a + 32], high[a : a + 32]
                    f = (lo[:, None] + (hi - lo)[:, None] * (1 + places) / 2).ravel()
                    total = np.zeros((6, len(f)))
                    for b in range(0, len(t), 2048):
                        z = np.exp(1j * TAU * np.outer(f, t[b : b + 2048]))
                        one, two, own = z.sum(1), (z * z).sum(1), z @ x[b : b + 2048]
                        total += np.stack([one.real, one.imag, two.real, two.imag, own.real, own.imag])
                    n = len(places)
                    key = pa.array([batch.column(0)[r].as_py()] * len(f), batch.column(0).type)
                    fixed = [np.repeat(lo, n), np.repeat(hi, n), np.tile(np.arange(n, dtype=np.int32), len(lo))]
                    yield pa.RecordBatch.from_arrays([key, *map(pa.array, fixed), *map(pa.array, total)], ["series_id", "low", "high", "node", *SUMS])

    lists = asked.groupBy("series_id").agg(F.collect_list(F.struct("low", "high")).alias("o"))  # no more than the limit
    rows = same(blocks, lists.select("series_id", F.transform("o", lambda o: o["low"]).alias("low"), F.transform("o", lambda o: o["high"]).alias("high")), ["series_id"])
    kind = dict(blocks.dtypes)["series_id"]
    found = rows.select("series_id", "t", "x", "low", "high").mapInArrow(run, f"series_id {kind}, low double, high double, node int, " + ", ".join(f"{c} double" for c in SUMS))
    return found.groupBy("series_id", "low", "high", "node").agg(*[F.sum(c).alias(c) for c in SUMS])


def integrand() -> Column:
    """Real part of the cross spectrum (kind "co"), or of the pair periodogram (kind "legacy"), of joined sides 1 and 2."""
    co = 0.5 * (F.col("a1") * F.col("a2") + F.col("b1") * F.col("b2"))
    return F.when(F.col("kind") == "co", co).otherwise(F.col("u1") * F.col("u2") + F.col("v1") * F.col("v2"))


def with_sides(pairs: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    side = lambda k: parts.select(F.col("series_id").alias(f"series{k}"), *keys, *[F.col(c).alias(f"{c}{k}") for c in "abuv"])
    return pairs.join(side(1), ["series1", *[k for k in keys if k in pairs.columns]]).join(side(2), ["series2", *keys])


def parts_of(sums: DataFrame, stats: DataFrame, mode: str) -> DataFrame:
    rows = components(same(sums, stats, ["series_id"]), mode=mode)
    return rows.withColumns({"u": (F.col("xc") - F.col("mean") * F.col("c1")) / F.col("n"), "v": (F.col("xs") - F.col("mean") * F.col("s1")) / F.col("n")})


def evaluated(blocks: DataFrame, stats: DataFrame, open_: DataFrame, mode: str) -> DataFrame:
    """The open intervals (pair, low, high) with value and error. Written."""
    asked = open_.select(F.explode(F.array("series1", "series2")).alias("series_id"), "low", "high").distinct()
    middle = (F.col("low") + F.col("high")) / 2
    rule = open_.sparkSession.createDataFrame([(i, *x) for i, x in enumerate(RULE)], "node int, place double, kronrod double, gauss double")
    sums = sums_at(blocks, asked).join(F.broadcast(rule), "node")
    sums = sums.withColumn("omega", F.lit(TAU) * (middle + (F.col("high") - F.col("low")) / 2 * F.col("place")))
    parts = written(parts_of(sums, stats, mode).select("series_id", "low", "high", "node", "a", "b", "u", "v", "kronrod", "gauss"), "parts")
    both = with_sides(open_, parts, ["low", "high", "node"]).join(F.broadcast(rule), "node")
    half = (F.col("high") - F.col("low")) / 2
    y = integrand() * half
    found = both.groupBy(*PAIR, "low", "high").agg(F.sum(y * F.col("kronrod")).alias("value"), F.sum(y * F.col("gauss")).alias("g"))
    return written(found.select(*PAIR, "low", "high", "value", F.abs(F.col("value") - F.col("g")).alias("error")), "evaluated")


def dense_values(blocks: DataFrame, stats: DataFrame, pairs: DataFrame, low: float, high: float, mode: str, points: int = DENSE) -> DataFrame:
    """series1, series2, kind, value: the trapezoid on a grid of so many points, by runs of its frequencies."""
    step = (high - low) / (points - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                t, x = (np.asarray(batch.column(c)[r].values) for c in (1, 2))
                for a in range(0, points, 512):
                    k = np.arange(a, min(points, a + 512))
                    total = np.zeros((6, len(k)))
                    for b in range(0, len(t), 2048):
                        z = np.exp(1j * TAU * np.outer(low + k * step, t[b : b + 2048]))
                        one, two, own = z.sum(1), (z * z).sum(1), z @ x[b : b + 2048]
                        total += np.stack([one.real, one.imag, two.real, two.imag, own.real, own.imag])
                    key = pa.array([batch.column(0)[r].as_py()] * len(k), batch.column(0).type)
                    yield pa.RecordBatch.from_arrays([key, pa.array(k.astype(np.int32)), *map(pa.array, total)], ["series_id", "k", *SUMS])

    named = pairs.select(F.explode(F.array("series1", "series2")).alias("series_id")).distinct()
    kind = dict(blocks.dtypes)["series_id"]
    sums = blocks.join(named, "series_id", "left_semi").select("series_id", "t", "x").mapInArrow(run, f"series_id {kind}, k int, " + ", ".join(f"{c} double" for c in SUMS))
    sums = sums.groupBy("series_id", "k").agg(*[F.sum(c).alias(c) for c in SUMS]).withColumn("omega", F.lit(TAU) * (F.lit(low) + F.col("k") * F.lit(step)))
    parts = written(parts_of(sums, stats, mode).select("series_id", "k", "a", "b", "u", "v"), "dense")
    weight = F.when(F.col("k").isin(0, points - 1), 0.5).otherwise(1.0) * F.lit(step)
    return with_sides(pairs, parts, ["k"]).groupBy(*PAIR).agg(F.sum(weight * integrand()).alias("value"))


def pair_integrals(series: DataFrame, pairs: DataFrame, low: float, high: float, ladder: tuple[tuple[float, int], ...] = LADDER, mode: str = "compat", start: int = 4, points: int = DENSE) -> DataFrame:
    """series1, series2, kind, value, error, status, message, attempts, intervals, messages of pairs (series1, series2, kind; the same series twice: its power).

    status is "ok" where an attempt came to its tolerance, else "fallback", or "failed" if that isn't finite either. Null series ids
    aren't integrated, nor are pairs of series without observations.
    """
    spark = series.sparkSession
    blocks = packed(series)
    stats = written(series.groupBy("series_id").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd")), "stats")
    cuts = F.explode(F.sequence(F.lit(0), F.lit(start - 1)))
    width = (high - low) / start
    open_ = pairs.select(*PAIR).distinct().withColumn("k", cuts).select(*PAIR, (F.lit(low) + F.col("k") * width).alias("low"), (F.lit(low) + (F.col("k") + 1) * width).alias("high"))
    leaves, settled, failures = evaluated(blocks, stats, open_, mode), [], []
    for attempt, (tolerance, most) in enumerate(ladder, 1):
        while True:
            sums = leaves.groupBy(*PAIR).agg(F.sum("value").alias("value"), F.sum("error").alias("error"), F.count("*").alias("intervals"), F.bool_and(is_finite(F.col("value"))).alias("finite"))
            allowed = F.greatest(F.lit(tolerance), F.lit(tolerance) * F.abs("value"))
            state = F.when(~F.col("finite"), "bad").when(F.col("error") <= allowed, "ok").when(F.col("intervals") >= most, "full").otherwise("open")
            judged = written(sums.withColumns({"allowed": allowed, "state": state}), "judged")
            going = judged.where("state = 'open'").select(*PAIR, F.col("allowed"))
            share = F.col("allowed") * (F.col("high") - F.col("low")) / F.lit(high - low)
            split = leaves.join(going, PAIR).where(F.col("error") > share)
            worst = leaves.join(going, PAIR).groupBy(*PAIR).agg(F.max(F.struct("error", "low")).alias("w"))  # one at least, if rounding leaves none
            split = written(split.select(*PAIR, "low", "high").union(leaves.join(worst, PAIR).where(F.col("low") == F.col("w.low")).select(*PAIR, "low", "high")).distinct(), "split")
            if split.isEmpty():
                break
            middle = (F.col("low") + F.col("high")) / 2
            halves = split.select(*PAIR, "low", middle.alias("high")).union(split.select(*PAIR, middle.alias("low"), "high"))
            kept = leaves.join(split, [*PAIR, "low", "high"], "left_anti").select(*PAIR, "low", "high", "value", "error")
            leaves = written(kept.union(evaluated(blocks, stats, halves, mode).select(*kept.columns)), "leaves")
        done = judged.where("state = 'ok'").select(*PAIR, "value", "error", F.lit("ok").alias("status"), F.lit("OK").alias("message"), F.lit(attempt).alias("attempts"), "intervals")
        settled.append(done)
        failures.append(judged.where("state <> 'ok'").select(*PAIR, F.when(F.col("state") == "bad", NOT_FINITE).otherwise(LIMIT).alias("message")))
        left = written(judged.where("state <> 'ok'").select(*PAIR, "error", "intervals"), "left")
        if left.isEmpty():
            break
        leaves = leaves.join(left.select(*PAIR), PAIR, "left_semi")
    else:
        dense = dense_values(blocks, stats, left.select(*PAIR), low, high, mode, points)
        status = F.when(is_finite(F.col("value")), "fallback").otherwise("failed")
        last = left.join(dense, PAIR, "left").select(*PAIR, "value", "error", status.alias("status"), F.when(status == "failed", NOT_FINITE).otherwise(STANDS_IN).alias("message"), F.lit(len(ladder) + 1).alias("attempts"), "intervals")
        settled.append(last)
    told = reduce(DataFrame.union, failures).groupBy(*PAIR).agg(F.array_sort(F.collect_set("message")).alias("messages"))
    return written(reduce(DataFrame.union, settled).join(told, PAIR, "left").withColumn("messages", F.coalesce("messages", F.array().cast("array<string>"))), "integrals")


def divergence_integrals(integrals: DataFrame) -> DataFrame:
    """series1, series2, ix, iy, ixy, j of co-spectrum integrals of pairs and of each series with itself."""
    co = integrals.where("kind = 'co'")
    auto = lambda k, c: co.where("series1 = series2").select(F.col("series1").alias(f"series{k}"), F.col("value").alias(c))
    rows = co.where("series1 <> series2").select("series1", "series2", F.col("value").alias("ixy")).join(auto(1, "ix"), "series1").join(auto(2, "iy"), "series2")
    return rows.withColumn("j", F.lit(0.25) * (F.col("ix") + F.col("iy") - 2 * F.col("ixy")) / F.lit(TAU))
