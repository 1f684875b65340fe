"""Adaptive integrals of pairs, running prefixes, likelihood estimates, samples; null series."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumachron.functions.sql import register
from lumachron.operators import autoregression, cleaning, frontier, prefixes

MIN, MAX = 0.01, 0.2


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(5)
    return {n: (np.sort(r.uniform(-15, 15, k)), r.normal(0, 1, k)) for n, k in (("a", 40), ("b", 55), ("c", 30))}


@pytest.fixture(scope="module")
def series(spark, data):
    rows = [(n, float(t), float(x), k) for n, (ts, xs) in data.items() for k, (t, x) in enumerate(zip(ts, xs))]
    return spark.createDataFrame(rows, "series_id string, t double, x double, row_id long").repartition(3)


def parts_by_hand(t, x, f):
    """a, b (compat) and the demeaned sums u, v over n at frequencies f."""
    w = 2 * np.pi * np.asarray(f)[:, None]
    tau = np.arctan(np.sin(2 * w * t).sum(1) / np.cos(2 * w * t).sum(1))[:, None] / (2 * np.pi)
    c, s, z = np.cos((tau - t) * w), np.sin((tau - t) * w), x - x.mean()
    return (c @ z) / np.sqrt((c * c).sum(1)) / z.std(ddof=1), (s @ z) / np.sqrt((s * s).sum(1)) / z.std(ddof=1), np.cos(w * t) @ z / len(t), np.sin(w * t) @ z / len(t)


def dense(data, one, two, kind, low, high, n=40_001):
    f = np.linspace(low, high, n)
    p, q = parts_by_hand(*data[one], f), parts_by_hand(*data[two], f)
    y = 0.5 * (p[0] * q[0] + p[1] * q[1]) if kind == "co" else p[2] * q[2] + p[3] * q[3]
    return float(((y[1:] + y[:-1]) / 2).sum() * (high - low) / (n - 1))


def test_frontier_integrals(spark, series, data):
    """Smooth integrands come to their tolerance; ones with jumps go down the ladder, and in the end to the dense grid."""
    pairs = spark.createDataFrame([("a", "b", "legacy"), ("a", "a", "legacy"), ("b", "c", "co"), ("a", "a", "co")], "series1 string, series2 string, kind string")
    found = {(r["series1"], r["series2"], r["kind"]): r for r in frontier.pair_integrals(series, pairs, MIN, MAX, ((1e-9, 60), (1e-5, 60)), points=4001).collect()}
    assert len(found) == 4
    for key, r in found.items():
        assert r["value"] == pytest.approx(dense(data, *key, MIN, MAX), abs=1e-6 if r["status"] == "ok" and r["attempts"] == 1 else 2e-3), key
    smooth = found[("a", "b", "legacy")]
    assert (smooth["status"], smooth["message"], smooth["attempts"], smooth["messages"]) == ("ok", "OK", 1, []) and smooth["error"] < 1e-9
    rough = found[("b", "c", "co")]
    assert rough["messages"] == [frontier.LIMIT] and rough["attempts"] > 1 and rough["message"] in ("OK", frontier.STANDS_IN)
    bad = series.union(spark.createDataFrame([("z", 0.0, float("nan"), 1)], series.schema))
    none = frontier.pair_integrals(bad, spark.createDataFrame([("z", "z", "co")], pairs.schema), MIN, MAX, ((1e-9, 20),), points=101).first()
    assert none["status"] == "failed" and none["messages"] == [frontier.NOT_FINITE]


def test_running_prefixes(series, data):
    """Every length is as if its observations were all there are."""
    got = prefixes.prefix_divergences(series, 20, 10, 4, 0.02).collect()
    assert {(r["series1"], r["series2"], r["length"]) for r in got} == {("a", "b", n) for n in (20, 30, 40)} | {(p, "c", n) for p in "ab" for n in (20, 30)}
    f, w = np.arange(1, 5) * 0.02, np.array([0.5, 1, 1, 0.5]) * 0.02
    for r in got:
        p, q = (parts_by_hand(*(v[: r["length"]] for v in data[s]), f) for s in (r["series1"], r["series2"]))
        assert r["j"] == pytest.approx(0.25 / (2 * np.pi) * (w * 0.5 * ((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2)).sum(), rel=1e-8)


def nll(phi, t, x):
    z = (x - x.mean()) / x.std(ddof=1)
    d = np.diff(t)
    some = d > 0
    p = phi ** d[some]
    v, e = 1 - p * p, z[1:][some] - p * z[:-1][some]
    return 0.5 * (z[0] ** 2 + (np.log(v) + e * e / v).sum())


def test_maximum_likelihood(spark):
    """phi to 1e-6 of a search by golden sections; flags for series that have no inner optimum or no likelihood."""
    r, data = np.random.default_rng(6), {}
    for name, phi, n in (("low", 0.2, 600), ("mid", 0.7, 500), ("high", 0.97, 800), ("short", 0.6, 5)):
        t, x = np.cumsum(r.exponential(1.0, n)), np.zeros(n)
        for k in range(n):
            p = phi ** (t[k] - t[k - 1]) if k else 0.0
            x[k] = p * x[k - 1] + math.sqrt(1 - p * p) * r.normal()
        data[name] = t, x
    data["shaky"] = np.arange(200.0), np.tile([1.0, -1.0], 100)  # neighbours differ: phi goes to 0
    data["once"] = np.array([1.0, 1.0]), np.array([2.0, 3.0])
    rows = [(n, float(t), float(x), k) for n, (ts, xs) in data.items() for k, (t, x) in enumerate(zip(ts, xs))]
    found = {q["series_id"]: q for q in autoregression.maximum_likelihood(spark.createDataFrame(rows, "series_id string, t double, x double, row_id long").repartition(3)).collect()}
    assert {n: q["status"] for n, q in found.items()} | {"short": ""} == {"low": "ok", "mid": "ok", "high": "ok", "short": "", "shaky": "boundary", "once": "none"}
    for name in ("low", "mid", "high"):
        grid = np.arange(1, 50) / 50
        at = grid[np.argmin([nll(p, *data[name]) for p in grid])]
        a, b = at - 0.02, min(at + 0.02, 1 - 1e-9)
        for _ in range(80):
            c, d = b - (b - a) * 0.618033988749895, a + (b - a) * 0.618033988749895
            a, b = (a, d) if nll(c, *data[name]) < nll(d, *data[name]) else (c, b)
        assert found[name]["phi"] == pytest.approx((a + b) / 2, abs=1e-6) and found[name]["rounds"] < 15


def test_samples_are_stable(series):
    one = sorted(map(tuple, cleaning.sampled(series, 7, 3).collect()))
    assert one == sorted(map(tuple, cleaning.sampled(series.repartition(9), 7, 3).collect())) and len(one) == 21
    parts = cleaning.sampled(series.where("row_id % 2 = 0"), 7, 3).union(cleaning.sampled(series.where("row_id % 2 = 1"), 7, 3))
    assert one == sorted(map(tuple, cleaning.sampled(parts, 7, 3).collect()))
    assert cleaning.sampled(series, 1000).count() == 125 and one != sorted(map(tuple, cleaning.sampled(series, 7, 4).collect()))


def test_sql_functions(spark, data):
    """Table functions and scalars in SQL; what is asked for wrongly is named."""
    register(spark)
    got = [tuple(r) for r in spark.sql("SELECT ieee_div(1D, 0D), ieee_div(-1D, 0D), ieee_div(0D, 0D), ieee_div(3D, 2D), ieee_div(NULL, 0D)").collect()][0]
    assert got[:2] == (math.inf, -math.inf) and math.isnan(got[2]) and got[3:] == (1.5, None)
    assert [tuple(r)[:2] for r in spark.sql("SELECT * FROM freq_grid(3, 0.5D)").collect()] == [(1, 0.5), (2, 1.0), (3, 1.5)]
    rows = [(n, float(t), float(x)) for n, (ts, xs) in data.items() for t, x in zip(ts, xs)] + [("one", 1.0, 2.0), ("none", None, 1.0), (None, 1.0, 1.0), (None, 2.0, 3.0)]
    spark.createDataFrame(rows, "series_id string, t double, x double").repartition(3).createOrReplaceTempView("own_series")
    found = {(r["series_id"], r["freq_id"]): r for r in spark.sql("SELECT * FROM periodogram(TABLE(own_series) PARTITION BY (series_id), 5, 0.03D)").collect()}
    assert {k[0] for k in found} == {"a", "b", "c", "one", None} and len(found) == 25 and math.isnan(found[("one", 1)]["power"])
    for name in data:
        a, b, _, _ = parts_by_hand(*data[name], np.arange(1, 6) * 0.03)
        assert [found[(name, k)]["a"] for k in range(1, 6)] == pytest.approx(a.tolist()) and [found[(name, k)]["b"] for k in range(1, 6)] == pytest.approx(b.tolist())
    with pytest.raises(Exception, match="no column x"):
        spark.sql("SELECT * FROM periodogram(TABLE(SELECT series_id, t FROM own_series) PARTITION BY (series_id), 5, 0.03D)").collect()


def test_null_series_are_series(spark):
    rows = spark.createDataFrame([(s, float(k), float(k % 5 + 1), k) for s in ("a", None) for k in range(5)], "series_id string, t double, x double, row_id long")
    assert cleaning.sigma_clip(rows, 5.0, 3).count() == 10 and cleaning.positive_clip(rows).count() == 10 and cleaning.magnitudes(rows).where("mag is not null").count() == 10
    assert cleaning.absolute_time(rows, 10.0).where("t >= 10").count() == 10 and cleaning.stitched(rows.withColumn("segment", F.lit(1))).count() == 10
    assert autoregression.standardised(rows).count() == 10 and autoregression.folded(rows, 0.3).count() == 10
    labels = spark.createDataFrame([(1, None), (1, "X"), (2, None)], "g int, label string").repartition(1)
    assert {r["g"]: r["l"] for r in labels.groupBy("g").agg(cleaning.label_consensus("label").alias("l")).collect()} == {1: "X", 2: "MIXED_FLUX"}


def test_runs_hold_all_rows(spark):
    """Runs of equal length; the last starts earlier if need be; a short series is a run; a null key is a series."""
    from lumachron.operators.tapers import runs

    rows = [(s, i, n) for s, n in (("a", 10), ("b", 8), (None, 3), ("d", 4), ("e", 5)) for i in range(1, n + 1)]
    got = runs(spark.createDataFrame(rows, "series_id string, i long, n long").withColumn("was", F.col("i")), 4).collect()
    by = {}
    for r in got:
        by.setdefault((r["series_id"], r["run"]), {})[r["i"]] = (r["was"], r["n"])
    assert {k: [w for w, _ in (v[i] for i in sorted(v))] for k, v in by.items()} == {("a", 0): [1, 2, 3, 4], ("a", 1): [5, 6, 7, 8], ("a", 2): [7, 8, 9, 10], ("b", 0): [1, 2, 3, 4], ("b", 1): [5, 6, 7, 8], (None, 0): [1, 2, 3], ("d", 0): [1, 2, 3, 4], ("e", 0): [1, 2, 3, 4], ("e", 1): [2, 3, 4, 5]}
    assert all(sorted(v) == list(range(1, len(v) + 1)) and {n for _, n in v.values()} == {len(v)} for v in by.values())


@pytest.mark.parametrize("many", [2, 3, 1000])
def test_carries_in_lists_of_any_length(spark, many):
    """What reaches each block, in one list or several; block numbers have gaps, null keys are keys."""
    rng = np.random.default_rng(3)
    rows = [(s, int(b), float(rng.normal()), float(rng.uniform(0, 1))) for s in ("a", None) for b in rng.choice(30, 9, replace=False)]
    got = autoregression.carried(spark.createDataFrame(rows, "series_id string, block int, x double, decay double"), ("series_id",), many).collect()
    want = {}
    for s in ("a", None):
        carry = 0.0
        for _, b, x, decay in sorted((r for r in rows if r[0] == s), key=lambda r: r[1]):
            want[s, b] = carry
            carry = x + decay * carry
    assert {(r["series_id"], r["block"]): pytest.approx(r["carry"], abs=1e-12) for r in got} == want
