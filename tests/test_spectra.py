"""Components and spectra against the micro-fixture, and the invariants that hold for any series."""

import math
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumachron.operators import autoregression, cleaning, divergence, integrals, spectra, tapers
from lumachron.operators.moments import components, moments, sampling

T1, X1, T2, X2 = [0.0, 1.0, 3.0], [1.0, 2.0, 4.0], [0.0, 2.0, 3.0, 5.0], [2.0, 1.0, 5.0, 3.0]
#: Expected values at omega 0.5, 1 and 2.
EXPECTED = {
    "tau1": [0.168746003401, 0.0616470165809, -0.131607300692],
    "a1": [-0.661595767313, -1.36270568876, 0.253263318454],
    "b1": [-0.993279130127, -0.117535469414, 0.512909793405],
    "a2": [-0.749975343646, -0.672455170738, 0.784533076088],
    "b2": [-0.338796050779, 0.928566105705, -0.0822833484601],
    "co": [0.416349779777, 0.403609516743, 0.0782447575138],
    "qu": [-0.260394411888, -0.672199824393, -0.21161702593],
    "power1": [0.712156194836, 0.935390690374, 0.163609382322],
    "cross_amplitude": [6.56470391905, 16.7349494723, 1.38572021075],
    "phase1": [4.2299138387, 3.29737890506, 1.31420452258],
    "compat": [1.75584521636, 3.23602918011, 3.82218406063],
    "fixed": [0.558902890977, 1.03006008001, 1.21663897331],
    "re": [0.333616772967, 0.57995507279, 0.0433980940548],
    "im": [0.101682770271, 0.390760319972, 0.169123551513],
}


@pytest.fixture(scope="module")
def series(spark):
    rows = [("1", t, x, k) for k, (t, x) in enumerate(zip(T1, X1))] + [("2", t, x, k) for k, (t, x) in enumerate(zip(T2, X2))]
    return spark.createDataFrame(rows, "series_id string, t double, x double, row_id long")


def at(df, *columns):
    rows = {round(r["omega"], 6): r for r in df.collect()}
    return SimpleNamespace(**{c: [rows[w][c] for w in (0.5, 1.0, 2.0)] for c in columns})


def test_micro_fixture(series):
    sums = moments(series, 4, 0.5, variable="omega")
    full, raw = components(sums), components(sums, standardise=False)
    one = at(full.where("series_id = '1'").withColumn("power", spectra.power()), "tau", "a", "b", "power")
    for name, got in (("tau1", one.tau), ("a1", one.a), ("b1", one.b), ("power1", one.power)):
        assert got == pytest.approx(EXPECTED[name], abs=1e-9)
    pair = at(spectra.pairs(full).withColumns({"co": spectra.cospectrum(), "qu": spectra.quadrature()}), "co", "qu", "a2", "b2")
    for name in ("co", "qu", "a2", "b2"):
        assert getattr(pair, name) == pytest.approx(EXPECTED[name], abs=1e-9)
    cross = at(spectra.pairs(raw).withColumns({"amp": spectra.cross_amplitude(), "compat": spectra.cross_phase(), "fixed": spectra.cross_phase(True), "coh": spectra.squared_coherence()}), "amp", "compat", "fixed", "coh")
    assert cross.amp == pytest.approx(EXPECTED["cross_amplitude"], abs=1e-8)
    assert cross.compat == pytest.approx(EXPECTED["compat"], abs=1e-8) and cross.fixed == pytest.approx(EXPECTED["fixed"], abs=1e-8)
    assert cross.coh == pytest.approx([4, 4, 4], abs=1e-9)
    assert at(raw.where("series_id = '1'").withColumn("p", spectra.phase()), "p").p == pytest.approx(EXPECTED["phase1"], abs=1e-8)
    re, im = spectra.legacy_cross()
    legacy = at(spectra.pairs(spectra.fourier_sums(sums), "u", "v").withColumns({"re": re, "im": im}), "re", "im")
    assert legacy.re == pytest.approx(EXPECTED["re"], abs=1e-9) and legacy.im == pytest.approx(EXPECTED["im"], abs=1e-9)


def test_power_product_and_divergence(series):
    parts = spectra.pairs(components(moments(series)))
    product = (0.5 * (F.col("a1") ** 2 + F.col("b1") ** 2)) * (0.5 * (F.col("a2") ** 2 + F.col("b2") ** 2))
    gap = F.abs(spectra.cospectrum() ** 2 + spectra.quadrature() ** 2 - product)
    assert parts.select(F.max(gap)).first()[0] < 1e-9
    assert divergence.divergences(parts, ["series1", "series2"], 200, 0.001).first()["j"] >= 0


def test_affine_invariance(series):
    moved = series.withColumn("x", F.col("x") * 3 + 7)
    a, b = (components(moments(s, 20)).orderBy("series_id", "freq_id").select("a", "b").toPandas().to_numpy() for s in (series, moved))
    assert np.allclose(a, b, atol=1e-9)


def test_degenerate_series(spark):
    rows = spark.createDataFrame([("flat", 0.0, 5.0), ("flat", 1.0, 5.0), ("single", 2.0, 1.0)], "series_id string, t double, x double")
    found = {r["series_id"]: r for r in components(moments(rows, 1)).collect()}
    assert math.isnan(found["flat"]["a"]) and math.isnan(found["single"]["a"])
    assert {r["series_id"]: r["n"] for r in sampling(rows).collect()} == {"flat": 2, "single": 1}
    assert components(moments(rows.limit(0), 1)).count() == 0


def test_origin_matters_in_compat_mode_only(series):
    moved = series.withColumn("t", F.col("t") + 19723)
    power = lambda s, mode: [r[0] for r in components(moments(s, 50, 0.007), mode=mode).orderBy("series_id", "freq_id").select(spectra.power()).collect()]
    assert np.allclose(power(series, "paper"), power(moved, "paper"), atol=1e-6)
    assert not np.allclose(power(series, "compat"), power(moved, "compat"), atol=1e-6)


def test_trapezoid_rules_agree(series):
    parts = components(moments(series)).withColumn("y", spectra.power())
    a = integrals.trapezoid(parts, ["series_id"], F.col("y"), 200, 0.001).orderBy("series_id").collect()
    b = integrals.trapezoid_of_points(parts, ["series_id"], "f", "y").orderBy("series_id").collect()
    assert [r[1] for r in a] == pytest.approx([r[1] for r in b], rel=1e-9)


def test_adaptive_quadrature(spark, series):
    square = lambda nodes: spark.createDataFrame([("k", i, j, f**10) for i, j, f in nodes], "key string, interval int, node int, y double")
    assert integrals.adaptive(spark, 0.0, 2.0, square).first()["integral"] == pytest.approx(2**11 / 11, rel=1e-12)
    evaluate = lambda nodes: integrals.power_at(components(integrals.node_moments(series, nodes), mode="paper"))
    found = {r["key"]: r["integral"] for r in integrals.adaptive(spark, 0.001, 0.2, evaluate, 1e-9, 6, 2).collect()}
    fine = integrals.trapezoid(components(moments(series, 2000, 0.0001), mode="paper").where("freq_id >= 10").withColumn("freq_id", F.col("freq_id") - 9), ["series_id"], spectra.power(), 1991, 0.0001)
    assert [found[k] for k in ("1", "2")] == pytest.approx([r[1] for r in fine.orderBy("series_id").collect()], rel=1e-4)


def test_tapers():
    v = tapers.prolate(64, 6, 4)
    assert np.allclose(v.T @ v, np.eye(6), atol=1e-9)
    i = np.arange(64)
    d = i[:, None] - i[None, :]
    kernel = np.where(d == 0, 2 * 4 / 64, np.sin(2 * np.pi * 4 / 64 * d) / (np.pi * np.where(d == 0, 1, d)))
    shares = np.diag(v.T @ kernel @ v)
    assert (shares[:5] > 0.99).all() and (np.diff(shares) < 1e-9).all()


def test_autoregression(spark):
    times = spark.range(4000).select(F.lit("s").alias("series_id"), (F.col("id") * 0.7 + F.rand(3) * 0.3).alias("t"), F.col("id").alias("row_id"))
    data = autoregression.simulated(times, 0.6, 5).persist()
    assert data.count() == 4000
    best = autoregression.estimated(data, rounds=2).first()
    assert best["phi"] == pytest.approx(0.6, abs=0.06)
    fit = autoregression.lagged(data).withColumn("fit", autoregression.fitted(F.lit(0.6)))
    assert fit.where("row_id = 0").first()["fit"] == 0
    data.unpersist()


def test_cleaning(spark):
    rows = spark.createDataFrame([("a", 1.0, -1.0), ("a", 2.0, 4.0), ("a", 3.0, float("nan")), ("a", 4.0, 9.0)], "series_id string, t double, x double")
    assert sorted(r["x"] for r in cleaning.positive_clip(rows).collect()) == [4.0, 4.0, 4.0, 9.0]
    with pytest.raises(Exception, match="no positive value"):
        cleaning.positive_clip(rows.withColumn("x", F.lit(-1.0))).collect()
    assert [r["t"] for r in cleaning.absolute_time(rows, 10.0, "force").orderBy("t").collect()] == [11.0, 12.0, 13.0, 14.0]
    with pytest.raises(KeyError):
        cleaning.choose_flux(rows.drop("x"))
    labels = spark.createDataFrame([(1, "A"), (1, "A"), (2, "A"), (2, "B")], "g int, label string")
    assert {r["g"]: r["l"] for r in labels.groupBy("g").agg(cleaning.label_consensus("label").alias("l")).collect()} == {1: "A", 2: "MIXED_FLUX"}
