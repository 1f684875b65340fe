"""Multitaper cross spectra with discrete prolate spheroidal tapers by sample index."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumachron.functions.numeric import TAU
from lumachron.operators.blocks import numbered, same, written
from lumachron.operators.divergence import divergences
from lumachron.operators.moments import components

#: Samples up to which tapers come from the whole matrix, and rows that are worked on at once.
DENSE, ROWS = 512, 2048
#: Series whose sums a task holds before it hands them on.
HELD = 64


def prolate(n: int, k: int, nw: float) -> np.ndarray:
    """n x k: the k leading tapers of n samples, unit vectors: eigenvectors of the commuting tridiagonal matrix.

    Even tapers have a positive sum, odd ones start positive (their sum times falling weights)."""
    i = np.arange(n)
    matrix = np.diag(((n - 1 - 2 * i) / 2) ** 2 * np.cos(2 * np.pi * nw / n))
    off = i[1:] * (n - i[1:]) / 2
    matrix += np.diag(off, 1) + np.diag(off, -1)
    v = np.linalg.eigh(matrix)[1][:, ::-1][:, :k]
    even = np.arange(v.shape[1]) % 2 == 0
    return v * np.where(np.where(even, v.sum(0), (n - 1 - 2 * i) @ v) < 0, -1, 1)


def steps(n: int, m: np.ndarray) -> np.ndarray:
    """y p_m = s_(m+1) p_(m+1) + s_m p_(m-1), for p_m orthonormal polynomials on the n samples, y their place from the middle."""
    m = m.astype(np.float64)
    return m / 2 * np.sqrt((float(n) ** 2 - m**2) / (4 * m**2 - 1))


@lru_cache(2 * DENSE)
def expansion(n: int, k: int, nw: float) -> np.ndarray:
    """The tapers of n samples: themselves for few samples, else their coefficients in the polynomials of `steps`.

    In that basis the tridiagonal matrix is -m (m + 1) / 2 - (1 - cos 2 pi W) y^2 but for a constant: five diagonals whose entries
    don't grow with n, and coefficients vanish soon after m = pi nw. So any n costs the same, and a sample's
    values need no other sample.
    """
    if n <= DENSE:
        return prolate(n, k, nw)
    most = min(n, int(2 * np.pi * nw) + 2 * k + 40)
    m = np.arange(most + 2)
    y = np.diag(steps(n, m[1:]), 1)
    square = ((y + y.T) @ (y + y.T))[:most, :most]
    c = np.linalg.eigh(np.diag(-m[:most] * (m[:most] + 1) / 2) - 2 * math.sin(math.pi * nw / n) ** 2 * square)[1][:, ::-1][:, :k]
    even = np.arange(c.shape[1]) % 2 == 0
    return c * np.where(np.where(even, c[0], -c[1]) < 0, -1, 1)


def tapers_at(i: np.ndarray, n: int, k: int, nw: float) -> np.ndarray:
    """len(i) x min(k, n): the values of the k leading tapers of n samples at samples i, from 1."""
    found = expansion(n, k, nw)
    if n <= DENSE:
        return found[i - 1]
    y, s = i - 1 - (n - 1) / 2, steps(n, np.arange(1, len(found) + 1))
    p, last = np.full(len(i), 1 / math.sqrt(n)), np.zeros(len(i))
    out = p[:, None] * found[0]
    for m in range(1, len(found)):
        p, last = (y * p - (s[m - 2] if m > 1 else 0.0) * last) / s[m - 1], p
        out += p[:, None] * found[m]
    return out


def wave_components(n: np.ndarray, mean: np.ndarray, sd: np.ndarray, plain: np.ndarray, own: np.ndarray, omega: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a and b as `components` has them (compat), from plain sums (c1, s1, c2, s2) and a value's own (xc, xs), with frequencies last."""
    with np.errstate(all="ignore"):
        c1, s1, c2, s2 = plain
        angle = omega * np.arctan(s2 / c2) / TAU
        ct, st, spread = np.cos(angle), np.sin(angle), np.cos(2 * angle) * c2 + np.sin(2 * angle) * s2
        yc, ys = (own[0] - mean * c1) / sd, (own[1] - mean * s1) / sd
        a = (ct * yc + st * ys) / np.sqrt(np.maximum((n + spread) / 2, 0.0))
        return a, (st * yc - ct * ys) / np.sqrt(np.maximum((n - spread) / 2, 0.0))


def deviations(n: np.ndarray, sx: np.ndarray, sxx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation from sums, no deviation of one value."""
    with np.errstate(all="ignore"):
        mean = sx / n
        return mean, np.sqrt(np.maximum(sxx - sx * mean, 0.0) / np.where(n > 1, n - 1, np.nan))


def band_integrals(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], step: float) -> np.ndarray:
    """Ix, Iy and Ixy of components with frequencies last, by the trapezoid rule."""
    weight = np.full(x[0].shape[-1], step)
    weight[[0, -1]] = step / 2
    with np.errstate(all="ignore"):
        return np.stack([0.5 * (p[0] * q[0] + p[1] * q[1]) @ weight for p, q in ((x, x), (y, y), (x, y))])


def tapered_moments(rows: DataFrame, bands: dict[float, int], values: tuple[str, ...] = ("x",), keys: tuple[str, ...] = ("series_id",), count: int = 200, step: float = 0.001) -> DataFrame:
    """Moments (as `moments` gives) of each value of rows (keys, t, i, n, values) under the k tapers of each nw in bands, and
    untapered for nw 0. Keys: keys, value, nw, taper, freq_id.

    Sines, cosines and tapers are worked out once a row for all of them; a task hands on sums by key and frequency.
    """
    names = [(v, float(nw), j) for v in values for nw, k in bands.items() for j in range(k if nw else 1)]
    label = [pa.array([x[c] for x in names for _ in range(count)]) for c in range(3)]
    freq = pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(names)))
    head = ["n", "sx", "sxx", "c1", "s1", "c2", "s2", "xc", "xs"]

    def handed(key: tuple, got: list[np.ndarray], types: list[pa.DataType]) -> pa.RecordBatch:
        wave, plain, xc, xs, here = got
        n, total = wave[:, 0], len(names) * count
        flat = [np.tile(n[0:1], total), np.repeat(plain[0], count), np.repeat(plain[1], count), *(np.tile(wave[:, c], len(names)) for c in range(1, 5)), xc.T.ravel(), xs.T.ravel()]
        own = np.repeat(here, count)
        fixed = [pa.array([v] * total, t) for v, t in zip(key, types)]
        whole = pa.RecordBatch.from_arrays([*fixed, label[0], label[1], pa.array(np.asarray(label[2]) + 1, pa.int32()), freq, *map(pa.array, flat)], [*keys, "value", "nw", "taper", "freq_id", *head])
        return whole.filter(pa.array(own))

    def add(held: dict, key: tuple, n: int, t: np.ndarray, i: np.ndarray, x: np.ndarray) -> None:
        columns, here = [], []
        drawn = {nw: tapers_at(i, n, k, nw) for nw, k in bands.items() if nw}
        for c in range(len(values)):
            for nw, k in bands.items():
                v = drawn[nw] if nw else np.ones((len(t), 1))
                full = np.zeros((len(t), k if nw else 1))
                full[:, : v.shape[1]] = v
                columns.append(full * x[:, c : c + 1])
                here += [j < v.shape[1] for j in range(full.shape[1])]
        a = np.concatenate(columns, 1)
        z = np.cumprod(np.broadcast_to(np.exp(1j * TAU * step * t)[:, None], (len(t), count)), 1)
        one, two = z.sum(0), np.einsum("ij,ij->j", z, z)
        wave = np.stack([np.full(count, float(len(t))), one.real, one.imag, two.real, two.imag], 1)
        got = [wave, np.stack([a.sum(0), (a * a).sum(0)]), z.real.T @ a, z.imag.T @ a]
        if key in held:
            for old, new in zip(held[key], got):
                old += new
        else:
            held[key] = [*got, np.array(here)]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}
        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.column(c).type for c in range(len(keys))]
            own = [batch.column(c).to_pylist() for c in range(len(keys))]
            n, i, t = (np.asarray(batch.column(c)) for c in ("n", "i", "t"))
            x = np.stack([np.asarray(batch.column(f"v{c}")) for c in range(len(values))], 1)
            at: dict[tuple, list[int]] = {}
            for r, key in enumerate(zip(*own)):
                at.setdefault(key, []).append(r)
            for key, places in at.items():
                for a in range(0, len(places), ROWS):
                    r = np.array(places[a : a + ROWS])
                    add(held, key, int(n[r[0]]), t[r], i[r], x[r])
                if len(held) > HELD:
                    for k in list(held):
                        yield handed(k, held.pop(k), types)
        for key, got in held.items():
            yield handed(key, got, types)

    narrow = rows.select(*keys, F.col("t").cast("double").alias("t"), F.col("i").cast("long").alias("i"), F.col("n").cast("long").alias("n"), *[F.col(v).cast("double").alias(f"v{c}") for c, v in enumerate(values)])
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "value string, nw double, taper int, freq_id int", *(f"{h} double" for h in head)])
    sums = narrow.mapInArrow(summed, schema).groupBy(*keys, "value", "nw", "taper", "freq_id").agg(*[F.sum(h).alias(h) for h in head])
    mean = F.col("sx") / F.col("n")
    variance = F.greatest(F.col("sxx") - F.col("sx") * mean, F.lit(0.0)) / F.when(F.col("n") > 1, F.col("n") - 1)
    f = F.col("freq_id") * F.lit(step)
    return sums.withColumns({"mean": mean, "sd": F.sqrt(variance), "f": f, "omega": F.lit(TAU) * f}).drop("sx", "sxx")


def multitaper_components(series: DataFrame, nw: float = 4, k: int | None = None, count: int = 200, step: float = 0.001) -> DataFrame:
    """Components of each whole series, demeaned, under each of k (2 nw unless given) tapers of the series' own length; a
    taper's series is demeaned and standardised once more. Keys: series_id, taper, freq_id."""
    rows = numbered(series.select("series_id", "t", "x", "row_id"))
    mean = rows.groupBy("series_id").agg(F.avg("x").alias("mean"))
    rows = rows.join(mean, "series_id").withColumn("x", F.col("x") - F.col("mean"))
    return components(tapered_moments(rows, {nw: max(1, 2 * int(nw) if k is None else k)}, count=count, step=step)).drop("value", "nw")


def multitaper_cross(parts: DataFrame) -> DataFrame:
    """series1, series2, freq_id, f, co: cospectra of pairs, averaged over tapers."""
    side = lambda k: parts.select("taper", "freq_id", "f", F.col("series_id").alias(f"series{k}"), F.col("a").alias(f"a{k}"), F.col("b").alias(f"b{k}"))
    joined = side(1).join(side(2).drop("f"), ["taper", "freq_id"]).where("series1 < series2")
    return joined.groupBy("series1", "series2", "freq_id", "f").agg(F.avg(0.5 * (F.col("a1") * F.col("a2") + F.col("b1") * F.col("b2"))).alias("co"))


def tapered_divergences(rows: DataFrame, bands: dict[float, int], keys: tuple[str, ...], count: int = 200, step: float = 0.001) -> DataFrame:
    """keys, nw, ix, iy, ixy, j: x of rows (keys, t, i, n, x, y) against their y, integrals averaged over the k tapers of each nw in bands; nw 0 is
    without taper. Both values are to be demeaned."""
    parts = written(components(tapered_moments(rows, bands, ("x", "y"), keys, count, step)).select(*keys, "value", "nw", "taper", "freq_id", "a", "b"), "parts")
    own = (*keys, "nw", "taper")
    both = parts.groupBy(*own, "freq_id").agg(*[F.max(F.when(F.col("value") == v, F.col(c))).alias(f"{c}{k}") for k, v in ((1, "x"), (2, "y")) for c in ("a", "b")])
    each = divergences(both, list(own), count, step)
    return each.groupBy(*keys, "nw").agg(*[F.avg(c).alias(c) for c in ("ix", "iy", "ixy", "j")]).withColumn("nw", F.col("nw").cast("int"))


def runs(rows: DataFrame, length: int) -> DataFrame:
    """Numbered rows (i from 1, n) in runs of `length` rows each: run, and i and n within it. If the last rows of a series don't fill a run, theirs starts
    earlier, so all rows are in a run and some of the rows before the last are in two. Shorter series have one run, themselves."""
    last = F.greatest(F.ceil(F.col("n") / length) - 1, F.lit(0)).cast("long")
    own = F.floor((F.col("i") - 1) / length).cast("long")
    again = (own == last - 1) & (F.col("i") > F.col("n") - length)
    found = rows.withColumn("run", F.explode(F.when(again, F.array(own, own + 1)).otherwise(F.array(own))))
    start = F.greatest(F.least(F.col("run") * length, F.col("n") - length), F.lit(0))
    return found.withColumns({"i": F.col("i") - start, "n": F.least(F.col("n"), F.lit(length))})


def run_divergences(rows: DataFrame, length: int, widths: tuple[int, ...], keys: tuple[str, ...] = ("series_id",), count: int = 200, step: float = 0.001) -> DataFrame:
    """keys, nw, runs, ix, iy, ixy, j: multitaper divergences of x from y by runs of numbered rows (keys, t, i, n, x, y), averaged over a series' runs.

    Tapers of a run know its rows alone, so a change along a series doesn't blur its spectrum, and runs are worked out apart. Null keys are series."""
    cut = runs(rows, length)
    own = (*keys, "run")
    means = cut.groupBy(*own).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    level = same(cut, means, list(own)).withColumns({"x": F.col("x") - F.col("mx"), "y": F.col("y") - F.col("my")})
    each = tapered_divergences(level, {nw: 2 * nw for nw in widths}, own, count, step)
    return each.groupBy(*keys, "nw").agg(F.count("*").alias("runs"), *[F.avg(c).alias(c) for c in ("ix", "iy", "ixy", "j")])


#: Runs that are worked on at once.
RUNS_AT_ONCE = 32


def run_integrals(t: np.ndarray, x: np.ndarray, ys: np.ndarray, widths: tuple[int, ...], count: int, step: float) -> np.ndarray:
    """fits x widths x 3: Ix, Iy and Ixy of runs (runs x rows) against each of their fits (fits x runs x rows), averaged over tapers and summed over runs.

    By observation throughout: values are demeaned, tapered and standardised, and components are sums of cosines and sines of shifted times."""
    length, omega = t.shape[1], TAU * step * np.arange(1, count + 1)
    drawn = [tapers_at(np.arange(1, length + 1), length, 2 * nw, nw) for nw in widths]
    starts, v = np.cumsum([0, *(d.shape[1] for d in drawn)]), np.concatenate(drawn, 1)
    total = np.zeros((len(ys), len(widths), 3))
    with np.errstate(all="ignore"):
        for a in range(0, len(t), RUNS_AT_ONCE):
            at = slice(a, a + RUNS_AT_ONCE)
            values = np.concatenate([x[None, at], ys[:, at]])
            under = (values - values.mean(2, keepdims=True))[..., None] * v
            under -= under.mean(2, keepdims=True)
            under /= np.sqrt((under * under).sum(2, keepdims=True) / (length - 1 if length > 1 else np.nan))
            angle = omega[:, None] * t[at, None, :]
            c, s = np.cos(angle), np.sin(angle)
            shift = (omega * np.arctan((2 * c * s).sum(2) / (2 * c * c - 1).sum(2)) / TAU)[..., None]
            c, s = np.cos(shift) * c + np.sin(shift) * s, np.sin(shift) * c - np.cos(shift) * s
            flat = under.transpose(1, 2, 0, 3).reshape(len(t[at]), length, -1)
            parts = [((w @ flat) / np.sqrt((w * w).sum(2))[..., None]).reshape(-1, count, len(values), v.shape[1]).transpose(2, 0, 3, 1) for w in (c, s)]
            for k in range(len(ys)):
                each = band_integrals((parts[0][0], parts[1][0]), (parts[0][k + 1], parts[1][k + 1]), step)
                total[k] += np.stack([each[..., i:j].mean(2).sum(1) for i, j in zip(starts, starts[1:])])
    return total
