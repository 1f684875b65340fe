"""What only larger or denser tables show: small gaps, repeated times, tables written and shuffled that outgrow their input."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumachron.jobs import registry
from lumachron.operators import autoregression, blocks, integrals, tapers


@pytest.fixture(scope="module")
def dense_events(tmp_path_factory):
    """Events a few microseconds apart, some at one time, in two types."""
    folder, rng = str(tmp_path_factory.mktemp("dense")), np.random.default_rng(8)
    us = 1_710_000_000_000_000 + np.cumsum(rng.choice([0, 1, 2, 7, 40_000, 3_000_000_000], 3000, p=[0.1, 0.1, 0.1, 0.1, 0.3, 0.3]))
    frame = pd.DataFrame({"event_id": np.arange(3000), "ts": us.astype("datetime64[us]"), "user_id": np.arange(3000) % 50, "event_type": rng.choice(["click", "view"], 3000), "value": rng.exponential(50, 3000).round(2)})
    con = duckdb.connect()
    con.sql(f"copy (select * from frame) to '{folder}/events.parquet'")
    return folder


def from_sql(name, folder, tables=("events",)):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con.sql(registry.ORACLES[name]).df()


def test_likelihood_of_small_gaps_equals_its_sql(spark, dense_events):
    """1 - phi^(2 gap) of a gap of microseconds has few digits, which are those of the times and of the power."""
    got, want = registry.QUERIES["iar_mle_grid"](spark, dense_events).toPandas(), from_sql("iar_mle_grid", dense_events)
    got, want = (x.sort_values("series_id").reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want[list(got.columns)], check_dtype=False, rtol=0, atol=1e-9)


@pytest.mark.parametrize("small", [False, True])
def test_nodes_take_each_time_once(spark, monkeypatch, small):
    """Sums at nodes are products of waves by distinct time: no row an observation and node is made, whatever the blocks, and null series are series."""
    if small:
        monkeypatch.setattr(integrals, "BLOCK", 7)
    rng = np.random.default_rng(2)
    data = {s: (rng.integers(0, 25, n).astype(float), rng.normal(3, 2, n)) for s, n in (("a", 300), (None, 40))}
    rows = [(s, float(t), float(x)) for s, (ts, xs) in data.items() for t, x in zip(ts, xs)]
    blocks, stats = integrals.at_times(spark.createDataFrame(rows, "series_id string, t double, x double").repartition(3))
    held = blocks.selectExpr("series_id", "size(t) as k", "aggregate(n, 0D, (a, b) -> a + b) as n").groupBy("series_id").agg({"k": "sum", "n": "sum"}).toPandas()
    assert sorted(held["sum(k)"]) == sorted(len(set(t)) for t, _ in data.values()) and sorted(held["sum(n)"]) == [40, 300]
    even = [(i, j, 0.01 + 0.02 * i + 0.003 * j) for i in range(4) for j in range(5)]
    odd = [(0, 0, 0.013), (0, 1, 0.4), (1, 0, 0.07), (2, 0, 0.2), (2, 1, 0.21)]
    parts = [(integrals.node_sums(blocks, stats, nodes), {(i, j): f for i, j, f in nodes}, ("interval", "node")) for nodes in (even, odd)]
    parts.append((integrals.even_moments(blocks, stats, 30, 0.004, 0.01), {(k, 1): 0.01 + (k - 1) * 0.004 for k in range(1, 31)}, ("freq_id", "n")))
    for found, nodes, (i, j) in parts:
        got = found.collect()
        assert len(got) == 2 * len(nodes)
        for r in got:
            t, x = data[r["series_id"]]
            w = 2 * np.pi * nodes[r[i], 1 if j == "n" else r[j]]
            c, s = np.cos(w * t), np.sin(w * t)
            want = [len(t), x.mean(), x.std(ddof=1), w, c.sum(), s.sum(), (2 * c * c - 1).sum(), (2 * c * s).sum(), (x * c).sum(), (x * s).sum()]
            assert [r[k] for k in ("n", "mean", "sd", "omega", "c1", "s1", "c2", "s2", "xc", "xs")] == pytest.approx(want, rel=1e-10, abs=1e-9)


@pytest.mark.parametrize("rows_a_block", [90, 100_000])
def test_sweep_writes_no_simulated_rows(spark, monkeypatch, rows_a_block):
    """Results are those of the simulated rows, whatever the blocks, but no table or shuffle holds a row an observation and phi."""
    rng = np.random.default_rng(6)
    data = {s: np.sort(np.concatenate([rng.uniform(0, 300, n), rng.integers(0, 300, n // 4), rng.integers(0, 300, n // 4)])) for s, n in (("a", 800), (None, 60), ("tiny", 4))}
    rows = spark.createDataFrame([(s, float(t), k) for s, ts in data.items() for k, t in enumerate(ts)], "series_id string, t double, row_id long").repartition(3)
    phis, widths, keys = [0.05, 0.6, 0.9], (2, 5), ("series_id", "true_phi")
    simulated = blocks.written(autoregression.simulated_sweep(rows.where("series_id is not null"), phis, 7), "simulated")
    best = blocks.written(autoregression.estimated(simulated, rounds=2, keys=keys).select(*keys, "phi"), "estimates")
    fit = blocks.same(autoregression.lagged(simulated, keys), best, list(keys)).withColumn("y", autoregression.fitted(F.col("phi")))
    level = blocks.same(blocks.numbered(fit, keys), fit.groupBy(*keys).agg(F.avg("x").alias("mx"), F.avg("y").alias("my")), list(keys))
    level = level.withColumns({"x": F.col("x") - F.col("mx"), "y": F.col("y") - F.col("my")})
    want = blocks.same(tapers.tapered_divergences(level, {0: 1, **{nw: 2 * nw for nw in widths}}, keys, 12, 0.02), best, list(keys)).toPandas()
    tables, write = {}, autoregression.written

    def counted(df, name):
        found = write(df, name)
        tables[name] = found.count()
        return found

    monkeypatch.setattr(blocks, "ROWS_A_BLOCK", rows_a_block)
    monkeypatch.setattr(autoregression, "written", counted)
    got = autoregression.sweep(rows, phis, widths, 12, 0.02, 7).toPandas()
    total = sum(map(len, data.values()))
    assert max(tables.values()) < total / 4
    null = got[got.series_id.isna()]
    assert len(got) == 3 * 3 * 3 and len(null) == 3 * 3 and null.j.notna().all()
    got, want = (x.dropna(subset="series_id").sort_values(["series_id", "true_phi", "nw"]).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want[list(got.columns)], check_dtype=False, rtol=1e-6, atol=1e-9)


def test_shocks_are_those_of_rows(spark):
    rows = spark.range(50).select(F.lit("s").alias("series_id"), (F.col("id") / 7).alias("t"), F.col("id").alias("row_id"), F.lit(0.985).alias("true_phi"))
    hashes = [F.xxhash64(F.lit(6 + k), "series_id", "t", "row_id").alias(f"h{k}") for k in (0, 1)]
    got = rows.select(autoregression.noise(3).alias("e"), *hashes).toPandas()
    assert autoregression.shocks(got.h0.to_numpy(), got.h1.to_numpy(), [0.2, 0.985])[:, 1] == pytest.approx(got.e.to_numpy(), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("rows_a_block", [100, 100_000])
def test_runs_leave_tasks_as_sums(spark, monkeypatch, dense_events, rows_a_block):
    """Equal to the SQL, also where blocks cut runs, and times are equal or close; what is written is not more than the rows."""
    tables, write = {}, autoregression.written

    def counted(df, name):
        found = write(df, name)
        tables[name] = found.count()
        return found

    monkeypatch.setattr(blocks, "ROWS_A_BLOCK", rows_a_block)
    for module in (autoregression, tapers):
        monkeypatch.setattr(module, "written", counted)
    got, want = registry.QUERIES["multitaper_runs"](spark, dense_events).toPandas(), from_sql("multitaper_runs", dense_events)
    assert max(tables.values()) <= 3500
    got, want = (x.sort_values(["series_id", "phi", "nw"]).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want[list(got.columns)], check_dtype=False, rtol=0, atol=2e-6)


def test_runs_of_short_and_null_series(spark):
    """As the general operator has them: a short series is one run, a null key is a series."""
    rng = np.random.default_rng(4)
    rows = [(s, float(t), float(x), k) for s, n in (("a", 40), (None, 25), ("b", 5), ("c", 16)) for k, (t, x) in enumerate(zip(np.sort(rng.uniform(0, 90, n)), rng.normal(size=n)))]
    series = spark.createDataFrame(rows, "series_id string, t double, x double, row_id long").repartition(3)
    got = autoregression.run_fits(series, (0.2, 0.8), 8, (2,), 9, 0.03).toPandas()
    fits = blocks.numbered(autoregression.lagged(autoregression.standardised(series))).withColumn("phi", F.explode(F.array(F.lit(0.2), F.lit(0.8))))
    want = tapers.run_divergences(fits.withColumn("y", autoregression.fitted(F.col("phi"))), 8, (2,), ("series_id", "phi"), 9, 0.03).toPandas()
    got, want = (x.fillna({"series_id": "-"}).sort_values(["series_id", "phi"]).reset_index(drop=True) for x in (got, want))
    assert len(got) == 8 and got[got.series_id == "b"].runs.tolist() == [1, 1]
    pd.testing.assert_frame_equal(got, want[list(got.columns)], check_dtype=False, rtol=1e-8, atol=1e-10)
