"""Fast transforms against direct sums, tiles against pairs one by one, nearest series and clusters against brute force."""

import math

import numpy as np
import pytest

from lumachron.operators import divergence, tiles, transforms
from lumachron.operators.moments import sampling


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(0)
    return {"a": (np.sort(r.uniform(0, 2400, 1500)), r.normal(0, 1, 1500)), "b": (r.uniform(100, 900, 300), r.normal(3, 2, 300)), None: (np.array([1.5, 2.5, 4.0]), np.array([2.0, 3.0, 1.0]))}


@pytest.fixture(scope="module")
def series(spark, data):
    rows = [(n, float(t), float(x)) for n, (ts, xs) in data.items() for t, x in zip(ts, xs)]
    return spark.createDataFrame(rows, "series_id string, t double, x double").repartition(3)


def sums_by_hand(t, x, k, step):
    one, two = np.exp(2j * np.pi * step * np.outer(k, t)), np.exp(4j * np.pi * step * np.outer(k, t))
    return {"c1": one.sum(1).real, "s1": one.sum(1).imag, "c2": two.sum(1).real, "s2": two.sum(1).imag, "xc": (one @ x).real, "xs": (one @ x).imag}


@pytest.mark.parametrize("most", [18, 8, 5])
def test_fast_transform(spark, series, data, most):
    """In one step and in two, for long and short series; a null series is a series."""
    tops = spark.createDataFrame([("a", 400), ("b", 40), (None, 3)], "series_id string, top long")
    got = transforms.band_sums(series, tops, 0.001, most).toPandas()
    assert len(got) == 443
    for name, (t, x) in data.items():
        own = got[got.series_id.isna() if name is None else got.series_id == name].sort_values("freq_id")
        for column, want in sums_by_hand(t, x, own.freq_id.to_numpy(), 0.001).items():
            assert own[column].to_numpy() == pytest.approx(want, abs=1e-8), (name, column)


def components_by_hand(t, x, f):
    w = 2 * np.pi * f
    tau = math.atan(np.sin(2 * w * t).sum() / np.cos(2 * w * t).sum()) / (2 * np.pi)
    c, s, z = np.cos((tau - t) * w), np.sin((tau - t) * w), (x - x.mean()) / x.std(ddof=1)
    return (z * c).sum() / np.sqrt((c * c).sum()), (z * s).sum() / np.sqrt((s * s).sum())


def test_components_at_a_hundred_frequencies(spark, series, data):
    tops = divergence.band_tops(sampling(series.where("series_id is not null")), 0.001)
    parts = transforms.band_components(series, tops, 0.001).toPandas()
    for name in ("a", "b"):
        own = parts[parts.series_id == name].sort_values("freq_id")
        assert own.freq_id.tolist() == list(range(1, len(own) + 1)) and len(own) == tops.where(f"series_id = '{name}'").first()["top"]
        for k in np.linspace(0, len(own) - 1, 100).astype(int).tolist():
            a, b = components_by_hand(*data[name], (k + 1) * 0.001)
            assert own.a.iloc[k] == pytest.approx(a, abs=1e-6) and own.b.iloc[k] == pytest.approx(b, abs=1e-6)


def test_whole_days_past_half_a_cycle(spark):
    """All sines vanish at half a cycle a day: the components are those of direct sums, never infinite."""
    r = np.random.default_rng(3)
    rows = [(n, float(t), float(x)) for n in "xy" for t, x in zip(r.integers(8000, 8400, 900), r.normal(0, 1, 900))]
    series = spark.createDataFrame(rows, "series_id string, t double, x double")
    parts = transforms.band_components(series, spark.createDataFrame([("x", 60), ("y", 60)], "series_id string, top long"), 0.01).toPandas()
    assert np.isfinite(parts[["a", "b"]].to_numpy()).all() and parts.b.abs().max() < 10
    found = divergence.first_band_divergences(series, divergence.band_tops(sampling(series), 0.01), 0.01).toPandas()
    assert len(found) == 2 and (found.top > 50).all() and np.isfinite(found.j).all()


def test_components_round_as_direct_sums(spark, monkeypatch):
    """With places, rounded components are those of sums by observation, times in blocks or not, null series and equal times among them."""
    r = np.random.default_rng(4)
    data = {n: (r.integers(9000, 9400, 700).astype(float), r.normal(5, 2, 700)) for n in ("x", None)}
    series = spark.createDataFrame([(n, float(t), float(x)) for n, (ts, xs) in data.items() for t, x in zip(ts, xs)], "series_id string, t double, x double")
    monkeypatch.setattr(transforms, "TIMES", 100)
    monkeypatch.setattr(transforms, "FREQUENCIES", 64)
    parts = transforms.band_components(series, spark.createDataFrame([("x", 490), (None, 300)], "series_id string, top long"), 0.001, places=11).toPandas()
    assert len(parts) == 790
    for name, (t, x) in data.items():
        own = parts[parts.series_id.isna() if name is None else parts.series_id == name].sort_values("freq_id")
        want = np.array([components_by_hand(t, x, k * 0.001) for k in own.freq_id])
        assert np.abs(own[["a", "b"]].to_numpy() - want).max() < 2e-11


def test_series_without_a_band(spark, series):
    one = series.unionByName(spark.createDataFrame([("z", 1.0, 1.0)], "series_id string, t double, x double")).where("series_id is not null")
    tops = {x["series_id"]: (x["top"], x["status"]) for x in divergence.band_tops(sampling(one), 0.01, False).collect()}
    assert tops["z"] == (0, "no band") and tops["a"][1] == ""
    found = divergence.first_band_divergences(one, divergence.band_tops(sampling(one), 0.01, False), 0.01).toPandas()
    assert {(a, b) for a, b in zip(found.series1, found.series2)} == {("a", "b"), ("b", "a"), ("a", "z"), ("b", "z")}


COUNT, STEP = 20, 0.01


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(1)
    names = [f"s{i:02d}" for i in range(60)]
    v = r.normal(0, 3, (5, 2 * COUNT))[r.integers(0, 5, 60)] + r.normal(0, 0.4, (60, 2 * COUNT))
    v[7] = v[3]  # ties
    rows = [(names[i], k + 1, float(v[i, k]), float(v[i, COUNT + k])) for i in range(60) for k in range(COUNT)]
    return names, v, spark.createDataFrame(rows, "series_id string, freq_id long, a double, b double").repartition(3)


def matrix_by_hand(v):
    w = np.full(COUNT, STEP)
    w[0] = w[-1] = STEP / 2
    gap = v[:, None] - v[None]
    return 0.25 / (2 * np.pi) * 0.5 * (gap**2 * np.tile(w, 2)).sum(2)


def test_pairs_by_tiles(vectors):
    names, v, parts = vectors
    got, want = tiles.pair_divergences(parts, COUNT, STEP, tile=16, chunk=7).toPandas(), matrix_by_hand(v)
    assert len(got) == 60 * 59 / 2 and (got.series1 < got.series2).all()
    assert got.j.to_numpy() == pytest.approx([want[names.index(a), names.index(b)] for a, b in zip(got.series1, got.series2)], abs=1e-12)


def test_nearest_by_pivots(vectors):
    names, v, parts = vectors
    j = matrix_by_hand(v)
    for k, pivots, tile in ((1, 3, 1), (3, 8, 16)):
        found, counts = tiles.nearest_by_pivots(parts, COUNT, STEP, k, pivots, tile, 7)
        got = {(r["series1"], r["rank"], r["series2"]) for r in found.collect()}
        assert got == {(names[i], at, names[n]) for i in range(60) for at, n in enumerate(sorted((n for n in range(60) if n != i), key=lambda n: (round(j[i, n], 12), names[n]))[:k], 1)}
        counted = counts.first()
        assert counted["refused"] > 300 and counted["pairs"] + counted["refused"] == 60 * 59 / 2
    assert tiles.nearest_by_pivots(parts.where("series_id = 's00'"), COUNT, STEP, 2)[0].count() == 0


def test_single_linkage(spark, vectors):
    names, v, parts = vectors
    j = matrix_by_hand(v)
    tree = tiles.single_linkage(parts, COUNT, STEP, 16, 7)
    root, want = {n: n for n in names}, {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for height, a, b in sorted((round(j[i, k], 15), names[i], names[k]) for i in range(60) for k in range(i + 1, 60)):
        if find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
            want[(a, b)] = height
    got = {(r["a"], r["b"]): r["j"] for r in tree.collect()}
    assert sorted(got.values()) == pytest.approx(sorted(want.values()), abs=1e-12) and got.keys() == want.keys()
    every = parts.select("series_id").distinct()
    for clusters in (1, 5, 60):
        cut = {r["series_id"]: r["cluster"] for r in tiles.cut(tree, every, clusters).collect()}
        assert len(cut) == 60 and len(set(cut.values())) == clusters
    high = sorted(want.values())[-4]
    by_height = {r["series_id"]: r["cluster"] for r in tiles.cut(tree, every, height=high - 1e-9).collect()}
    assert by_height == {r["series_id"]: r["cluster"] for r in tiles.cut(tree, every, 5).collect()}
    assert tiles.single_linkage(parts.where("series_id = 's00'"), COUNT, STEP).count() == 0
