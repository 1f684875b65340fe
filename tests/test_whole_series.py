"""Series of any length are worked on whole: results don't depend on blocks, and nothing past a bound is lost."""

import os
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumachron.jobs import registry
from lumachron.operators import autoregression, blocks, cleaning, tapers
from lumachron.operators.moments import with_own_grid


def brute_components(t, x, v, count, step):
    """a, b by observation under each taper."""
    out = []
    for k in range(v.shape[1]):
        y = (x - x.mean()) * v[:, k]
        y = (y - y.mean()) / y.std(ddof=1)
        for f in range(1, count + 1):
            w = 2 * np.pi * f * step
            tau = np.arctan(np.sin(2 * w * t).sum() / np.cos(2 * w * t).sum()) / (2 * np.pi)
            c, s = np.cos((tau - t) * w), np.sin((tau - t) * w)
            out.append((k + 1, f, (y * c).sum() / np.sqrt((c * c).sum()), (y * s).sum() / np.sqrt((s * s).sum())))
    return np.array(out)


def test_tapers_of_any_length():
    for n in (513, 900):
        whole = tapers.tapers_at(np.arange(1, n + 1), n, 8, 4)
        assert np.allclose(whole, tapers.prolate(n, 8, 4), atol=1e-10)
    n = 50_000
    v = tapers.tapers_at(np.arange(1, n + 1), n, 8, 4)
    assert np.allclose(v.T @ v, np.eye(8), atol=1e-10)


def test_multitaper_takes_whole_series(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS_A_BLOCK", 700)
    rng = np.random.default_rng(4)
    data = {"a": (np.sort(rng.uniform(0, 900, 5000)), rng.normal(5, 2, 5000)), "b": (np.sort(rng.uniform(0, 900, 130)), rng.normal(0, 1, 130)), "tiny": (np.array([0.0, 1.0, 2.5]), np.array([1.0, 5.0, 2.0]))}
    rows = [(s, float(t), float(x), k) for s, (ts, xs) in data.items() for k, (t, x) in enumerate(zip(ts, xs))]
    series = spark.createDataFrame(rows, "series_id string, t double, x double, row_id long").orderBy(F.rand(1))
    got = tapers.multitaper_components(series, 4, count=3, step=0.01).toPandas()
    for s, (t, x) in data.items():
        n = len(t)
        want = brute_components(t, x, tapers.prolate(n, 8, 4) if n < 4000 else tapers.tapers_at(np.arange(1, n + 1), n, 8, 4), 3, 0.01)
        own = got[got.series_id == s].sort_values(["taper", "freq_id"])
        assert len(own) == len(want) and (own.n == n).all()
        assert own[["taper", "freq_id"]].to_numpy().tolist() == want[:, :2].tolist()
        assert own[["a", "b"]].to_numpy() == pytest.approx(want[:, 2:], abs=1e-7, nan_ok=True)


@pytest.fixture(scope="module")
def times(spark):
    rows = spark.range(2500).select(F.lit("s").alias("series_id"), (F.floor(F.col("id") / 2) * 1.4 + F.rand(3) * 0.3).alias("t"), F.col("id").alias("row_id"))
    return blocks.written(rows.union(rows.where("id < 40").select(F.lit("r"), "t", "row_id")), "times")


def test_simulation_and_lags_do_not_depend_on_blocks(spark, times, monkeypatch):
    def drawn(rows_a_block):
        monkeypatch.setattr(blocks, "ROWS_A_BLOCK", rows_a_block)
        data = autoregression.simulated_sweep(times, [0.3, 0.985], 5)
        rows = autoregression.lagged(data.drop("block"), ("series_id", "true_phi")).toPandas()
        return rows.sort_values(["series_id", "true_phi", "t", "row_id"]).reset_index(drop=True), data.select("block").distinct().count()

    (one, _), (many, parts) = drawn(100_000), drawn(60)
    assert parts > 20
    columns = ["x", "gap", "before"]
    assert np.allclose(one[columns], many[columns], atol=1e-9, equal_nan=True)
    for _, own in many.groupby(["series_id", "true_phi"]):  # one chain: no border forgets what came before
        assert np.isnan(own.before.iloc[0]) and (own.before.to_numpy()[1:] == own.x.to_numpy()[:-1]).all()
        assert (own.gap.to_numpy()[1:] == np.diff(own.t)).all()
        assert 0.3 < own.x.std() < 2.5
    near = many[(many.series_id == "s") & (many.true_phi == 0.985)]
    assert np.corrcoef(near.x[1:], near.before[1:])[0, 1] > 0.95


def test_sweep_estimates_and_tapers(times):
    found = autoregression.sweep(times, [0.01, 0.5, 0.985], (2, 5), 20, 0.01).toPandas()
    assert sorted(set(found.nw)) == [0, 2, 5] and len(found) == 2 * 3 * 3
    own = found[(found.series_id == "s") & (found.nw == 0)].sort_values("true_phi")
    assert np.abs(own.phi - own.true_phi).max() < 0.1 and (own.phi != own.true_phi).any()
    assert (found.j >= 0).all() and found.j.nunique() == len(found)
    assert np.allclose(found.j, 0.25 * (found.ix + found.iy - 2 * found.ixy) / (2 * np.pi))


def test_grid_reaches_each_series_own_limit(spark):
    tops = spark.createDataFrame([("low", 0.0035), ("none", 0.0005), ("high", 33.3339), ("even", 0.25)], "series_id string, f_max double")
    for block in (7, 100_000):
        got = with_own_grid(tops, 0.001, block).groupBy("series_id").agg(F.count("*").alias("n"), F.min("freq_id").alias("a"), F.max("freq_id").alias("z"), F.count_distinct("freq_id").alias("d")).collect()
        assert {r["series_id"]: (r["n"], r["a"], r["z"], r["d"]) for r in got} == {"low": (3, 1, 3, 3), "high": (33333, 1, 33333, 33333), "even": (250, 1, 250, 250)}
    with pytest.raises(Exception, match="not finite"):
        with_own_grid(spark.createDataFrame([("x", float("inf"))], "series_id string, f_max double")).collect()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables aren't here")
def test_whole_grid_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{folder}/events.parquet'")
    got, want = registry.QUERIES["sampling_grid_whole"](spark, folder).toPandas(), con.sql(registry.ORACLES["sampling_grid_whole"]).df()
    assert len(got) > 100_000
    got, want = (x.sort_values(["series_id", "freq_id"]).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=2e-6)


def test_medians_need_no_whole_series(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS_A_BLOCK", 50)
    nan, rng = float("nan"), np.random.default_rng(2)
    data = {"even": rng.normal(size=1000).tolist(), "odd": rng.normal(size=777).tolist(), "hot": [0.0] * 600 + [-0.0] * 10 + rng.normal(size=500).tolist(), "nan": [1.0, nan, nan, 2.0], "null": [None, None], "some": [None, 3.0, 4.0], "one": [7.0], "inf": [1.0, float("inf")], None: [5.0, 6.0]}
    rows = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, x double").orderBy(F.rand(3))
    found = blocks.medians(rows, ("k",), "x")
    got, want = ({r["k"]: r["m"] for r in df.collect()} for df in (found.withColumnRenamed("middle", "m"), rows.groupBy("k").agg(F.median("x").alias("m"))))
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-15, nan_ok=True), k
    assert blocks.medians(rows.limit(0), ("k",), "x").count() == 0


def test_no_aggregate_or_window_takes_a_whole_series(spark, times):
    """Each series used to be one array, one buffer of values or one window."""
    x = times.withColumn("x", F.col("t") % 7)
    for df in (autoregression.simulated(times, 0.5), autoregression.lagged(x), cleaning.sigma_clip(x, 3.0, 1), cleaning.magnitudes(x), cleaning.absolute_time(x, 1.0), cleaning.stitched(x.withColumn("segment", F.lit(1)))):
        plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "median(" not in plan and "percentile(" not in plan
        assert "collect_list(struct(t" not in plan and not re.search(r"windowspecdefinition\(series_id#\d+, t#", plan)
