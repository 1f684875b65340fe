"""Moments on whole bands by a non-uniform fast transform, and direct sums where sums alone can't tell.

A series' sums over e^(2 pi i k step t), k = 1 to its top, are those of its observations spread onto an even mesh: each observation
goes to the WIDTH nearest mesh points by a smooth kernel, meshes of tasks add up, a Fourier transform of the mesh gives all
frequencies at once, and dividing by the kernel's own transform takes the kernel out. So the work is n + F log F in place
of n F, to some 1e-11 of the largest sum. Three meshes a series are enough: ones, values, and ones at twice the phase.

A mesh of M = R C points that is too large for one task goes in two steps: columns of length R, a twist, rows of length C. A task
holds some columns or some rows, so a series of any length is transformed by many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumachron.functions.numeric import TAU, ieee_div
from lumachron.operators.blocks import same, written
from lumachron.operators.moments import STEP, components

#: Mesh points that an observation is spread to, and the kernel's sharpness for a mesh twice as fine as needed.
WIDTH = 14
SHARPNESS = 2.30 * WIDTH
#: Mesh points that a task transforms at once, as a power of 2; longer meshes go in two steps.
AT_ONCE = 18
#: Spread values that a task holds before it adds up what fell on one point.
HELD = 1 << 21
#: A component whose denominator is below this share of the observations is taken from direct sums, and so is a shift whose cosine sum is.
WEAK = 1e-6
#: A transform's error, as a share of the observations.
TRANSFORM = 1e-12
#: Times and frequencies of a block of direct sums, and angles that are worked out at once.
TIMES, FREQUENCIES, ANGLES = 4096, 1024, 1 << 18
NAMES = ["c1", "s1", "xc", "xs", "c2", "s2"]


def kernel(distance: np.ndarray) -> np.ndarray:
    """The spreading kernel at distances of at most WIDTH / 2 mesh points."""
    return np.exp(SHARPNESS * (np.sqrt(np.maximum(1 - (2 * distance / WIDTH) ** 2, 0)) - 1))


def kernel_transform(k: np.ndarray, mesh: int) -> np.ndarray:
    """The kernel's own Fourier transform at frequency k of a mesh."""
    nodes, weights = np.polynomial.legendre.leggauss(64)
    u = nodes * WIDTH / 2
    return (kernel(u) * weights * WIDTH / 2) @ np.cos(TAU * np.outer(u, k / mesh))


def spread(phase: np.ndarray, mesh: int) -> tuple[np.ndarray, np.ndarray]:
    """Mesh points and kernel values, WIDTH of each, of each phase in [0, 1)."""
    at = phase * mesh
    first = np.ceil(at - WIDTH / 2)
    points = first[:, None] + np.arange(WIDTH)
    return points.astype(np.int64) % mesh, kernel(points - at[:, None])


def summed(points: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Values that fell on one point added up; points ascend."""
    own, place = np.unique(points, return_inverse=True)
    return own, *(np.bincount(place, v, len(own)) for v in values)


def shape(power: int) -> tuple[int, int, int, int]:
    """Rows R and columns C of a mesh of 2^power points, and the powers of R and C."""
    r = power // 2
    return 1 << r, 1 << (power - r), r, power - r


class Meshes:
    """Meshes of the series a task sees: points and values of ones and x, and of ones at twice the phase."""

    def __init__(self, power: int) -> None:
        self.power, self.plain, self.double, self.size = power, [], [], 0

    def add(self, t: np.ndarray, x: np.ndarray, step: float) -> None:
        turns = t * step
        points, weight = spread(turns - np.floor(turns), 1 << self.power)
        self.plain.append((points.ravel(), weight.ravel(), (weight * x[:, None]).ravel()))
        points, weight = spread(2 * turns - np.floor(2 * turns), 1 << self.power)
        self.double.append((points.ravel(), weight.ravel()))
        self.size += points.size
        if self.size > HELD:
            self.compact()

    def compact(self) -> None:
        self.plain = [summed(*(np.concatenate(c) for c in zip(*self.plain)))]
        self.double = [summed(*(np.concatenate(c) for c in zip(*self.double)))]
        self.size = len(self.plain[0][0])

    def by_columns(self, most: int) -> Iterator[tuple[int, list[np.ndarray]]]:
        """Number of a group of columns, and what falls into it: places (row by row of the group), ones, x; places, ones."""
        self.compact()
        _, columns, _, cp = shape(self.power)
        width = columns if self.power <= most else max(1, (1 << most) >> (self.power - cp))
        parts = []
        for points, *values in (self.plain[0], self.double[0]):
            row, column = points >> cp, points & (columns - 1)
            group, place = column // width, row * width + column % width
            order = np.argsort(group, kind="stable")
            parts.append((group[order], [place[order], *(v[order] for v in values)]))
        for g in np.union1d(parts[0][0], parts[1][0]).tolist():
            yield g, [c[s:e] for group, cs in parts for s, e in [np.searchsorted(group, [g, g + 1])] for c in cs]


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.append(0, np.cumsum([len(v) for v in values]))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(values), kind))


def spread_rows(series: DataFrame, step: float, most: int) -> DataFrame:
    """series_id, power, top, columns, and the sparse mesh values of a task's rows in that group of columns."""
    kinds = [pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64()]

    def hand_on(held: dict, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        for (key, top), mesh in held.items():
            found = list(mesh.by_columns(most))
            for at in range(0, len(found), 64):
                some = found[at : at + 64]
                fixed = [pa.array([v] * len(some), k) for v, k in ((key, kind), (mesh.power, pa.int32()), (top, pa.int64()))]
                data = [lists([v[c] for _, v in some], k) for c, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array([g for g, _ in some], pa.int64()), *data], ["series_id", "power", "top", "columns", "p", "one", "x", "q", "two"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Meshes] = {}
        kind = pa.string()
        for batch in batches:
            kind = batch.column(0).type
            coded = batch.column(0).dictionary_encode()
            code = np.asarray(coded.indices.fill_null(-1))
            names = coded.dictionary.to_pylist()
            t, x, power, top = (np.asarray(batch.column(c)) for c in range(1, 5))
            order = np.argsort(code, kind="stable")
            edges = np.flatnonzero(np.append(True, np.diff(code[order]) != 0))
            for s, e in zip(edges.tolist(), [*edges[1:].tolist(), len(order)]):
                for a in range(s, e, 16_384):
                    r = order[a : min(e, a + 16_384)]
                    key = (names[code[r[0]]] if code[r[0]] >= 0 else None), int(top[r[0]])
                    held.setdefault(key, Meshes(int(power[r[0]]))).add(t[r], x[r], step)
            if sum(m.size for m in held.values()) > 4 * HELD:
                yield from hand_on(held, kind)
                held = {}
        yield from hand_on(held, kind)

    schema = f"series_id {dict(series.dtypes)['series_id']}, power int, top long, columns long, p array<long>, one array<double>, x array<double>, q array<long>, two array<double>"
    return series.select("series_id", F.col("t").cast("double"), F.col("x").cast("double"), "power", "top").mapInArrow(run, schema)


def dense(rows: pa.Table, size: int) -> list[np.ndarray]:
    """The meshes of one group from its sparse rows: ones, x, ones at twice the phase."""
    flat = {c: np.asarray(rows.column(c).combine_chunks().flatten()) for c in ("p", "one", "x", "q", "two")}
    return [np.bincount(flat[p], flat[v], size) for p, v in (("p", "one"), ("p", "x"), ("q", "two"))]


def told(key: pa.Array, k: np.ndarray, meshes: list[np.ndarray], mesh: int) -> pa.Table:
    """series_id, freq_id and the six sums at frequencies k of transformed meshes (ones, x, twice)."""
    scale = kernel_transform(k, mesh)
    columns = [c / scale for m in meshes for c in (m.real, m.imag)]
    return pa.Table.from_arrays([key, pa.array(k), *map(pa.array, columns)], ["series_id", "freq_id", *NAMES])


def band_sums(series: DataFrame, tops: DataFrame, step: float = STEP, most: int = AT_ONCE) -> DataFrame:
    """series_id, freq_id, c1, s1, xc, xs, c2, s2 of each series (series_id, t, x) for all frequencies 1 to its top (tops: series_id, top)."""
    kind = dict(series.dtypes)["series_id"]
    power = F.greatest(F.ceil(F.log2(2.0 * (2 * F.col("top") + 1))), F.lit(6)).cast("int")
    planned = same(series.select("series_id", "t", "x"), tops.where("top >= 1").select("series_id", F.col("top").cast("long").alias("top"), power.alias("power")), ["series_id"])
    rows = written(spread_rows(planned, step, most), "meshes")
    out = f"series_id {kind}, freq_id long, " + ", ".join(f"{c} double" for c in NAMES)

    def whole(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        mesh, top = 1 << key[1].as_py(), key[2].as_py()
        k = np.arange(1, top + 1)
        return told(pa.array([key[0].as_py()] * top, rows.column("series_id").type), k, [np.fft.ifft(m)[1 : top + 1] * mesh for m in dense(rows, mesh)], mesh)

    small = rows.where(F.col("power") <= most).groupBy("series_id", "power", "top").applyInArrow(whole, out)
    if rows.where(F.col("power") > most).isEmpty():
        return small

    def columns_done(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        power, group = key[1].as_py(), key[3].as_py()
        r, c, rp, cp = shape(power)
        width, height = max(1, (1 << most) >> rp), max(1, (1 << most) >> cp)
        column = group * width + np.arange(width)
        twist = np.exp(1j * TAU * np.outer(np.arange(r), column) / (1 << power))
        done = [np.fft.ifft(m.reshape(r, width), axis=0) * r * twist for m in dense(rows, r * width)]
        blocks = [np.stack([m[a : a + height] for m in done]).tobytes() for a in range(0, r, height)]
        n = len(blocks)
        fixed = [pa.array([key[i].as_py()] * n, rows.column(name).type) for i, name in enumerate(("series_id", "power", "top", "columns"))]
        return pa.Table.from_arrays([*fixed, pa.array(range(n), pa.int64()), pa.array(blocks, pa.binary())], ["series_id", "power", "top", "columns", "rows", "data"])

    def rows_done(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        power, top, group = (key[i].as_py() for i in (1, 2, 3))
        r, c, rp, cp = shape(power)
        width, height = max(1, (1 << most) >> rp), max(1, (1 << most) >> cp)
        first = group * height
        height = min(height, r - first)
        whole = np.zeros((3, height, c), complex)
        for at, data in zip(rows.column("columns").to_pylist(), rows.column("data")):
            whole[:, :, at * width : (at + 1) * width] = np.frombuffer(data.as_buffer(), complex).reshape(3, height, width)
        done = np.fft.ifft(whole, axis=2) * c
        k = (first + np.arange(height))[:, None] + r * np.arange(c)
        inside = (k >= 1) & (k <= top)
        return told(pa.array([key[0].as_py()] * int(inside.sum()), rows.column("series_id").type), k[inside], [m[inside] for m in done], 1 << power)

    columns = rows.where(F.col("power") > most).groupBy("series_id", "power", "top", "columns")
    half = written(columns.applyInArrow(columns_done, f"series_id {kind}, power int, top long, columns long, rows long, data binary"), "columns")
    return small.union(half.groupBy("series_id", "power", "top", "rows").applyInArrow(rows_done, out))


def band_moments(series: DataFrame, tops: DataFrame, step: float = STEP, most: int = AT_ONCE) -> DataFrame:
    """What `moments` gives, on each series' own band."""
    stats = series.groupBy("series_id").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
    f = F.col("freq_id") * F.lit(step)
    return same(band_sums(series, tops, step, most), stats, ["series_id"]).withColumn("f", f).withColumn("omega", F.lit(TAU) * f)


def tiles_of(times: DataFrame, frequencies: DataFrame, columns: list[str]) -> DataFrame:
    """Every block of a series' times (series_id, part, t, n, x) with every block of its frequencies (series_id, freq_id and columns), dealt over all tasks."""
    blocks = frequencies.withColumn("k", F.floor(F.col("freq_id") / F.lit(FREQUENCIES))).groupBy("series_id", "k").agg(F.collect_list(F.struct("freq_id", *columns)).alias("wanted"))
    blocks = blocks.select("series_id", "k", F.col("wanted.freq_id").alias("freq_id"), *[F.col(f"wanted.{c}").alias(c) for c in columns])
    return same(blocks, times, ["series_id"]).repartition(4 * times.sparkSession.sparkContext.defaultParallelism, "series_id", "k", "part")


def tile_sums(tiles: DataFrame, columns: list[str], names: list[str], sums: Callable[..., list[np.ndarray]]) -> DataFrame:
    """series_id, freq_id, columns, and the sums by name over all of a series' times; sums: from freq_id, columns, t, n and x, for a few frequencies at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                given = {c: np.asarray(batch.column(c)[i].values) for c in ("freq_id", *columns, "t", "n", "x")}
                each = [given[c][:, None] for c in ("freq_id", *columns)]
                few = max(1, ANGLES // len(given["t"]))
                found = [sums(*[c[at : at + few] for c in each], given["t"], given["n"], given["x"]) for at in range(0, len(each[0]), few)]
                done = [np.concatenate(c) for c in zip(*found)]
                key = batch.column("series_id").take(pa.array([i] * len(each[0])))
                yield pa.RecordBatch.from_arrays([key, *[pa.array(given[c]) for c in ("freq_id", *columns)], *map(pa.array, done)], ["series_id", "freq_id", *columns, *names])

    kind = dict(tiles.dtypes)["series_id"]
    found = tiles.mapInArrow(run, f"series_id {kind}, freq_id long, " + ", ".join(f"{c} double" for c in [*columns, *names]))
    return found.groupBy("series_id", "freq_id", *columns).agg(*[F.sum(c).alias(c) for c in names])


def direct_components(series: DataFrame, wanted: DataFrame, step: float = STEP) -> DataFrame:
    """series_id, freq_id, tau, a, b by observation, demeaned and standardised, for wanted (series_id, freq_id, mean, sd): the shift first, then
    sums of the shifted sines and cosines themselves.

    Observations of one time share their sines, and go in blocks of times, frequencies in blocks as well; a task has some pairs of blocks."""
    wanted = written(wanted.select("series_id", F.col("freq_id").cast("long").alias("freq_id"), "mean", "sd"), "wanted")
    stats = wanted.groupBy("series_id").agg(F.first("mean").alias("mean"), F.first("sd").alias("sd"))
    rows = same(series.select("series_id", F.col("t").cast("double").alias("t"), "x"), stats, ["series_id"])
    each = rows.groupBy("series_id", "t").agg(F.count("*").cast("double").alias("n"), F.sum(F.col("x") - F.col("mean")).alias("x"))
    each = written(each, "times")
    most = each.groupBy("series_id").count().agg(F.max("count")).first()[0] or 1
    each = each.withColumn("part", F.pmod(F.xxhash64("t"), F.lit(-(-most // TIMES))))
    times = each.groupBy("series_id", "part").agg(F.collect_list(F.struct("t", "n", "x")).alias("rows")).select("series_id", "part", *[F.col(f"rows.{c}").alias(c) for c in "tnx"])
    times = written(times, "time_blocks")

    def shift_sums(k: np.ndarray, t: np.ndarray, n: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        angle = 2 * (TAU * k * step) * t
        return [np.sin(angle) @ n, np.cos(angle) @ n]

    def shifted_sums(k: np.ndarray, tau: np.ndarray, t: np.ndarray, n: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        turned = (tau - t) * (TAU * k * step)
        c, s = np.cos(turned), np.sin(turned)
        return [c @ x, s @ x, (c * c) @ n, (s * s) @ n]

    tau = F.atan(ieee_div(F.col("s2"), F.col("c2"))) / F.lit(TAU)
    shifts = written(tile_sums(tiles_of(times, wanted.select("series_id", "freq_id"), []), [], ["s2", "c2"], shift_sums).select("series_id", "freq_id", tau.alias("tau")), "shifts")
    sums = same(tile_sums(tiles_of(times, shifts, ["tau"]), ["tau"], ["nc", "ns", "dc", "ds"], shifted_sums), stats, ["series_id"])
    each = lambda p, q: ieee_div(ieee_div(F.col(p), F.coalesce("sd", F.lit(float("nan")))), F.sqrt(q))
    return sums.select("series_id", "freq_id", "tau", each("nc", "dc").alias("a"), each("ns", "ds").alias("b"))


def unsettled(places: int) -> Column:
    """Whether a or b is so near to a half of the last of `places` decimals that the rounding of angles and of the transform may decide where it goes.

    A bound: phases are off by a few units in the last place of the largest angle, sums by that for each observation, and the shift by what sums are off over their length."""
    n, omega, turned = F.col("n"), F.col("omega"), F.abs(F.cos(2 * F.col("omega") * F.col("tau")) * F.col("c2") + F.sin(2 * F.col("omega") * F.col("tau")) * F.col("s2"))
    off = 8 * omega * F.col("reach") * F.lit(2.0**-53) + F.lit(TRANSFORM)
    flat = ieee_div(2 * n, n - turned)
    size = F.abs("a") + F.abs("b")
    angle = omega * ieee_div(n * off, F.sqrt(F.col("c2") * F.col("c2") + F.col("s2") * F.col("s2"))) * F.lit(math.sqrt(2) / TAU)
    error = size * flat * (angle + off) + F.sqrt(2 * n * flat) * off
    near = lambda c: F.abs(F.abs(c) * F.lit(10.0**places) % 1 - 0.5) <= error * F.lit(10.0**places)
    return near("a") | near("b")


def band_components(series: DataFrame, tops: DataFrame, step: float = STEP, most: int = AT_ONCE, places: int | None = None) -> DataFrame:
    """series_id, freq_id, f, tau, a, b of each series on its own band.

    Where nearly all sines or cosines vanish (as for whole days at half a cycle a day), the difference of sums that stands for
    the denominator is rounding alone; where the cosine sum of the shift is next to nothing, its sign is. Those few frequencies come from direct sums.
    With places, so do those whose a or b, rounded to so many decimals, might be another than that of direct sums: few on short bands, most where
    angles are large, at a cost of distinct times by frequencies.
    """
    sums = written(band_moments(series, tops, step, most), "sums")
    parts = components(sums)
    angle = 2 * F.col("omega") * F.col("tau")
    turned = F.abs(F.cos(angle) * F.col("c2") + F.sin(angle) * F.col("s2"))
    weak = F.isnan("tau") | (F.abs("c2") < WEAK * F.col("n")) | ((F.col("n") - turned) / 2 < WEAK * F.col("n"))
    if places is not None:
        reach = series.groupBy("series_id").agg(F.max(F.abs(F.col("t").cast("double"))).alias("reach"))
        parts, weak = same(parts, reach, ["series_id"]), weak | unsettled(places)
    direct = direct_components(series, parts.where(weak).select("series_id", "freq_id", "mean", "sd"), step)
    joined = same(parts.select("series_id", "freq_id", "f", "tau", "a", "b"), direct.select("series_id", "freq_id", F.col("tau").alias("tau_"), F.col("a").alias("a_"), F.col("b").alias("b_"), F.lit(True).alias("direct")), ["series_id", "freq_id"], "left")
    chosen = [F.when(F.col("direct"), F.col(f"{c}_")).otherwise(F.col(c)).alias(c) for c in ("tau", "a", "b")]
    return joined.select("series_id", "freq_id", "f", *chosen)
