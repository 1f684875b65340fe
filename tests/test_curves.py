"""Converter, guards, bands of their own, ladder, made-up series."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumachron.operators import cleaning, divergence, integrals, spectra
from lumachron.operators.moments import components, moments, sampling
from lumachron.sources import series as S
from lumachron.sources import synthetic


def test_text_by_folders(spark, tmp_path):
    """Written curves are read by the name of their folder, whatever it has in it."""
    names = ["007", "a b+c", "x=y/z%41", "é:1"]
    rows = spark.createDataFrame([(n, float(k), 1.5 * k, None) for n in names for k in range(3)], "series_id string, time double, mag double, mag_err double")
    S.write_light_curves(rows, str(tmp_path / "out"))
    back = S.read_light_curves(spark, str(tmp_path / "out"), by_folder=True)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def flux_by_hand(rows, offset, sigma, iterations):
    """rows (segment, t, x, e) of one series."""
    rows = [r for r in rows if r[2] is not None and not math.isnan(r[2])]
    middle = {s: float(np.median([x for g, _, x, _ in rows if g == s])) for s in {r[0] for r in rows}}
    kept = [(t, x / middle[s], e / middle[s]) for s, t, x, e in rows]
    for _ in range(iterations):
        x = np.array([r[1] for r in kept])
        kept = [r for r in kept if abs(r[1] - np.median(x)) <= sigma * x.std()]
    least = min(x for _, x, _ in kept if x > 0)
    kept = [(t, x if x > 0 else least, e) for t, x, e in kept]
    middle = float(np.median([x for _, x, _ in kept]))
    return {round(t + offset, 6): (-2.5 * math.log10(x / middle), 2.5 / math.log(10) * e / x if e > 0 else math.nan) for t, x, e in kept}


@pytest.mark.parametrize("mission", ["Kepler", "TESS"])
def test_light_curves(spark, mission):
    r = np.random.default_rng(1)
    rows = [(k // 20, 0.5 * k, float(x), 0.1 if k % 7 else -1.0) for k, x in enumerate(r.normal(10, 2, 60))]
    rows[5], rows[25], rows[45] = (0, 2.5, math.nan, 0.1), (1, 12.5, 500.0, 0.1), (2, 22.5, -3.0, 0.1)
    flux = spark.createDataFrame([("s", *x) for x in rows], "series_id string, segment long, t double, sap_flux double, x_err double")
    got = {round(x["time"], 6): (x["mag"], x["mag_err"]) for x in cleaning.light_curves(flux, mission, 3.0, 3).collect()}
    want = flux_by_hand(rows, cleaning.OFFSETS[mission], 3.0, 3)
    assert got.keys() == want.keys() and len(got) < 60
    for t in want:
        assert got[t] == pytest.approx(want[t], nan_ok=True)
    plain = cleaning.light_curves(flux.drop("x_err"), mission)
    assert plain.where("mag_err is not null").count() == 0 and plain.first()["flux_label"] == "SAP_FLUX"
    with pytest.raises(ValueError, match="mission"):
        cleaning.light_curves(flux, "Gaia")


def test_guard(spark):
    rows = spark.createDataFrame([("a", 1.0)], "series_id string, t double")
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "series_id string")
    assert cleaning.guarded(rows, names("a")).count() == 1
    with pytest.raises(Exception, match="empty series: b"):
        cleaning.guarded(rows, names("a", "b")).collect()


def test_first_bands(spark):
    """Each pair on the band of its first series, against sums by hand."""
    r = np.random.default_rng(2)
    data = {n: (np.sort(r.uniform(0, 60, k)), r.normal(0, 1, k)) for n, k in (("a", 25), ("b", 40))}
    rows = spark.createDataFrame([(n, float(t), float(x)) for n, (ts, xs) in data.items() for t, x in zip(ts, xs)], "series_id string, t double, x double")
    step = 0.01
    found = {x["series1"]: x for x in divergence.first_band_divergences(rows, divergence.band_tops(sampling(rows), step), step).collect()}

    def parts(n, f):
        t, x = data[n]
        w = 2 * np.pi * f
        tau = np.arctan(np.sin(2 * w * t).sum() / np.cos(2 * w * t).sum()) / (2 * np.pi)
        c, s, z = np.cos(w * (tau - t)), np.sin(w * (tau - t)), (x - x.mean()) / x.std(ddof=1)
        return (z * c).sum() / np.sqrt((c * c).sum()), (z * s).sum() / np.sqrt((s * s).sum())

    for one, two in (("a", "b"), ("b", "a")):
        t = data[one][0]
        top = math.ceil(1 / (2 * (t.max() - t.min()) / len(t)) / step)
        sums = np.zeros(3)
        for k in range(1, top + 1):
            (a1, b1), (a2, b2) = parts(one, k * step), parts(two, k * step)
            sums += (0.5 if k in (1, top) else 1) * step * 0.5 * np.array([a1 * a1 + b1 * b1, a2 * a2 + b2 * b2, a1 * a2 + b1 * b2])
        assert found[one]["top"] == top
        assert [found[one][c] for c in ("ix", "iy", "ixy")] == pytest.approx(sums.tolist(), rel=1e-9)
        assert found[one]["j"] == pytest.approx(0.25 * (sums[0] + sums[1] - 2 * sums[2]) / (2 * np.pi), rel=1e-9)
    with pytest.raises(Exception, match="no band: z"):
        divergence.band_tops(sampling(spark.createDataFrame([("z", 1.0, 1.0)], "series_id string, t double, x double")), step).collect()


def test_ladder_by_series(spark):
    """Only series that don't settle go on to the next step, and the last ones to the fallback."""
    asked = []

    def step(good, value):
        def run(keys):
            names = ["a", "b", "c"] if keys is None else sorted(r["key"] for r in keys.collect())
            asked.append(names)
            return spark.createDataFrame([(n, value, 0.0 if n in good else 1.0) for n in names], "key string, integral double, error double")

        return run

    found = integrals.with_ladder([step("a", 1.0), step("b", 2.0)], 0.1, step("", 3.0))
    assert {r["key"]: (r["integral"], r["way"]) for r in found.collect()} == {"a": (1.0, 0), "b": (2.0, 1), "c": (3.0, 2)}
    assert asked == [["a", "b", "c"], ["b", "c"], ["c"]]


def test_made_up_series(spark):
    times = synthetic.irregular_times(spark, 2, 600, seed=3, mean=0.05, long_mean=0.5, block=70)
    got = times.orderBy("series_id", "row_id").collect()
    for name in ("0", "1"):
        t = np.array([r["t"] for r in got if r["series_id"] == name])
        assert len(t) == 600 and (np.diff(t) > 0).all() and 0.07 < np.diff(t).mean() < 0.18
    again = synthetic.irregular_times(spark, 2, 600, seed=3, mean=0.05, long_mean=0.5, block=600).orderBy("series_id", "row_id").collect()
    assert [r["t"] for r in got] == pytest.approx([r["t"] for r in again], rel=1e-12)
    parts = components(moments(synthetic.sines(times, 0.7, 0.05), 100, 0.01), mode="paper")
    best = parts.withColumn("p", spectra.power()).groupBy("series_id").agg(F.max_by("f", "p").alias("f"), F.max(F.abs(F.col("a") * F.col("b") - F.col("b") * F.col("a"))).alias("im")).collect()
    assert all(r["f"] == pytest.approx(0.7) and r["im"] == 0 for r in best)


def test_pairs_across_catalogues(spark):
    rows = [(c, f"{c}{k}", float(t), float((t * (k + 2)) % 5)) for c in "xy" for k in range(2) for t in range(20)]
    series = spark.createDataFrame(rows, "catalogue string, series_id string, t double, x double")
    parts = components(moments(series, 5, 0.03, keys=("catalogue", "series_id")))
    found = spectra.pairs(parts, "a", "b", "catalogue", across=F.col("catalogue1") < F.col("catalogue2"))
    assert {(r["series1"], r["series2"]) for r in found.collect()} == {("x0", "y0"), ("x0", "y1"), ("x1", "y0"), ("x1", "y1")}
