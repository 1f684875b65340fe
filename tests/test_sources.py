"""Light-curve text: reading, edge cases, round trip; streaming moments."""

import pytest
from pyspark.sql import functions as F

from lumachron.operators.moments import moments
from lumachron.sources import series as S
from lumachron.streaming.moments import start


def test_read_light_curves(spark, tmp_path):
    (tmp_path / "SRV-BLG-LPV-000009.dat").write_text("# # c\n\n 446.7 18.7 0.04\n1 abc 0.1\n1 2 nan\n5 inf 6\n1.5d 3 4\n")
    (tmp_path / "SRV-BLG-LPV-000009.dat.txt").write_text("# # c\n\n 446.7 18.7 0.04\n1 abc 0.1\n1 2 nan\n5 inf 6\n1.5d 3 4\n")
    rows = S.read_light_curves(spark, str(tmp_path)).orderBy("time").collect()
    assert [(r["series_id"], r["time"], r["mag"]) for r in rows] == [("SRV-BLG-LPV-000009", 5.0, float("inf")), ("SRV-BLG-LPV-000009", 446.7, 18.7)]
    assert S.read_light_curves(spark, str(tmp_path), "loose").count() == 5
    assert S.read_light_curves(spark, str(tmp_path), skip_first_row=True).count() == 1
    parts = S.read_light_curves(spark, str(tmp_path)).select(*S.name_parts()).first()
    assert tuple(parts) == ("SRV", "BLG", "LPV", "000009")


def test_column_count(spark, tmp_path):
    (tmp_path / "x.dat").write_text("1\n")
    with pytest.raises(Exception, match="expected 2 or 3 columns"):
        S.read_light_curves(spark, str(tmp_path)).collect()


def test_columns_are_those_of_the_file(spark, tmp_path):
    """In a file of three columns a line of two lacks its error and goes; a file of two columns has none."""
    (tmp_path / "three.dat").write_text("1 2 0.1\n2 3\n3 4 0.2\n")
    (tmp_path / "two.dat").write_text("1 2\n2 3\n")
    rows = S.read_light_curves(spark, str(tmp_path)).collect()
    assert sorted((r["series_id"], r["time"], r["mag_err"]) for r in rows) == [("three", 1.0, 0.1), ("three", 3.0, 0.2), ("two", 1.0, None), ("two", 2.0, None)]
    assert S.read_light_curves(spark, str(tmp_path), "loose").count() == 5


def test_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2.0, 1.25, 0.5), ("a", 1.0, -3.5, 0.25), ("b", 7.0, 0.0, 0.125)], "series_id string, time double, mag double, mag_err double")
    S.write_light_curves(rows, str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out")).orderBy("series_id", "value")
    assert [tuple(r) for r in back.collect()] == [("1.00000000 -3.500000 0.250000", "a"), ("2.00000000 1.250000 0.500000", "a"), ("7.00000000 0.000000 0.125000", "b")]


def test_streaming_moments(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") % 3).cast("string").alias("series_id"), (F.col("id") * 0.37).alias("t"), F.sin("id").alias("x"))
    for k in range(3):
        rows.where(F.col("t") % 3 >= k).where(F.col("t") % 3 < k + 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = start(stream, "kept_moments", str(tmp_path / "checkpoint"), 5)
    q.processAllAvailable()
    q.stop()
    got = {(r["series_id"], r["freq_id"]): r for r in spark.table("kept_moments").collect()}
    for r in moments(rows, 5).collect():
        assert got[(r["series_id"], r["freq_id"])]["xc"] == pytest.approx(r["xc"], abs=1e-9)
        assert got[(r["series_id"], r["freq_id"])]["n"] == r["n"]
