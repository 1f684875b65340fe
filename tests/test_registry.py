"""The queries whose results SQL gives, against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from lumachron.jobs import curves, registry  # noqa: F401  both register queries

FOLDER = "/root/testdata/sf0.001"
CHECKED = [
    "series_stats", "sampling_grid", "power_spectrum", "cross_spectrum", "divergence_matrix", "legacy_cross", "sigma_clip", "stitch", "phase_fold", "iar_fit", "label_consensus",
    "own_band_divergence", "own_grid_components", "two_band_divergence", "nearest_panels", "panel_clusters", "legacy_integral", "prefix_divergence", "strict_reader", "loose_reader", "mission_to_text", "cross_catalogue", "spectrum_range", "target_dimension", "multitaper_runs", "iar_simulation",
]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, name, folder=FOLDER):
    con = duckdb.connect()
    for t in ("events", "orders", "customer"):
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, folder).toPandas(), con.sql(registry.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    keys = [c for c in columns if not pd.api.types.is_float_dtype(want[c]) or c in ("time", "phi")] or columns
    got, want = (x[columns].sort_values(keys).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=2e-6)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", ["own_band_divergence", "own_grid_components"])
def test_bands_past_half_a_cycle_a_day(spark, name):
    """The orders of the larger folder reach half a cycle a day, where whole days make sines vanish."""
    test_against_sql(spark, name, "/root/testdata/sf0.01")


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables aren't here")
def test_own_grid_components_round_as_their_sql_does(spark):
    """To the last of six decimals, also where a value is within 2e-12 of a half of it."""
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view orders as select * from '{folder}/orders.parquet'")
    keys = ["series_id", "freq_id"]
    got, want = registry.QUERIES["own_grid_components"](spark, folder).toPandas(), con.sql(registry.ORACLES["own_grid_components"]).df()
    both = got.merge(want, on=keys, suffixes=("", "_sql"))
    assert len(both) == len(got) == len(want)
    assert (both.a - both.a_sql).abs().max() < 1e-9 and (both.b - both.b_sql).abs().max() < 1e-9


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
