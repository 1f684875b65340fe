"""Streams with state by series: any cut into triggers gives the batch result; duplicates, late rows, restarts."""

import numpy as np
import pandas as pd
import pytest

from lumachron.operators.autoregression import estimated
from lumachron.operators.moments import moments
from lumachron.streaming.state import Sums, latest_fits, latest_moments, newest, run_available

SCHEMA = "series_id string, row_id long, t double, x double"


def observations(n=240, seed=5):
    """Three series, one without a name, with ties in time; a large mean; some rows twice."""
    rng = np.random.default_rng(seed)
    rows = pd.DataFrame({"series_id": rng.choice(["a", "b", None], n), "row_id": np.arange(n), "t": np.sort(np.round(rng.uniform(20000, 20080, n), 1)), "x": 1e4 + rng.normal(0, 2, n)})
    return rows


def fed(spark, folder, parts):
    """A stream of one file a trigger, in order."""
    folder.mkdir(exist_ok=True)
    have = len(list(folder.iterdir()))
    for k, part in enumerate(parts, have):
        part.to_parquet(folder / f"{k:03}.parquet", index=False)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def cut(rows, delay, parts, seed):
    """rows in that many parts: none comes more than `delay` after a later one, and each part repeats some rows of its own and of the part before."""
    rng = np.random.default_rng(seed)
    shuffled = rows.iloc[np.argsort(rows["t"] + rng.uniform(0, delay, len(rows)), kind="stable")]
    found = np.array_split(np.arange(len(rows)), parts)
    return [pd.concat([shuffled.iloc[p], shuffled.iloc[p[:3]], shuffled.iloc[before[:9]]]) for p, before in zip(found, [found[0], *found])]


def same_frames(got, want, keys):
    got, want = (f.sort_values(keys).reset_index(drop=True)[sorted(want.columns)] for f in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-7, atol=1e-7)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def test_sums_of_any_cut():
    rng = np.random.default_rng(1)
    t, x, phis = np.sort(np.round(rng.uniform(0, 50, 300), 1)), 500 + rng.normal(size=300), np.arange(1, 50) / 50
    whole = Sums(phis)
    whole.add(t, x)
    parts = Sums(phis)
    for a in (slice(0, 1), slice(1, 130), slice(130, 131), slice(131, 300)):
        parts = Sums(phis, parts.kept())
        parts.add(t[a], x[a])
    np.testing.assert_allclose(np.array(parts.fit(), float), np.array(whole.fit(), float), rtol=1e-10)
    assert Sums(phis).fit()[0] == 0


@pytest.mark.parametrize("parts", [1, 4])
def test_fits_equal_the_batch(rocks, tmp_path, parts):
    rows = observations()
    end = pd.DataFrame({"series_id": ["end"], "row_id": [-1], "t": [21000.0], "x": [0.0]})  # moves the watermark past all others
    odd = pd.DataFrame({"series_id": ["a", "b"], "row_id": [900, 901], "t": [None, 20001.0], "x": [1.0, float("nan")]})
    stream = fed(rocks, tmp_path / "in", [*cut(rows, 5.0, parts, 2), odd, end])
    run_available(latest_fits(stream, "5 days 1 hour"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = newest(rocks.read.parquet(str(tmp_path / "out"))).select("series_id", "n", "phi", "nll").toPandas()
    batch = rocks.createDataFrame(rows.astype({"series_id": object}).where(rows.notna(), None), SCHEMA)
    counts = batch.groupBy("series_id").count().withColumnRenamed("count", "n").toPandas()
    want = estimated(batch).toPandas().merge(counts, on="series_id")
    same_frames(got, want, ["n"])


def test_restart_and_late_rows(rocks, tmp_path):
    rows = observations(seed=8)
    parts = cut(rows, 2.0, 4, 3)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    run_available(latest_fits(fed(rocks, tmp_path / "in", parts[:2]), "3 days"), out, checkpoint)
    late = pd.DataFrame({"series_id": ["a"], "row_id": [950], "t": [20000.0], "x": [9e9]})
    end = pd.DataFrame({"series_id": ["end"], "row_id": [-1], "t": [21000.0], "x": [0.0]})
    run_available(latest_fits(fed(rocks, tmp_path / "in", [late, *parts[2:], end]), "3 days"), out, checkpoint)
    got = newest(rocks.read.parquet(out)).select("series_id", "n", "phi", "nll").toPandas()
    batch = rocks.createDataFrame(rows.astype({"series_id": object}).where(rows.notna(), None), SCHEMA)
    counts = batch.groupBy("series_id").count().withColumnRenamed("count", "n").toPandas()
    same_frames(got, estimated(batch).toPandas().merge(counts, on="series_id"), ["n"])


def test_moments_in_update_mode(rocks, tmp_path):
    rows = observations(seed=4)
    stream = fed(rocks, tmp_path / "in", cut(rows, 5.0, 3, 6))
    run_available(latest_moments(stream, "6 days", 4), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = newest(rocks.read.parquet(str(tmp_path / "out")).drop("batch"), ("series_id", "freq_id")).toPandas()
    batch = rocks.createDataFrame(rows.astype({"series_id": object}).where(rows.notna(), None), SCHEMA)
    same_frames(got, moments(batch, 4).toPandas(), ["freq_id", "n", "mean"])


def test_no_rows(rocks, tmp_path):
    stream = fed(rocks, tmp_path / "in", [observations().iloc[:0].astype({"series_id": str})])
    (tmp_path / "out").mkdir()
    run_available(latest_fits(stream, "1 day"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert newest(rocks.read.schema("series_id string, n long, phi double").parquet(str(tmp_path / "out"))).count() == 0
