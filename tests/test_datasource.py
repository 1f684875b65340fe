"""Data sources: light-curve text in ranges, a committing writer, and FITS binary tables written by the standard."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumachron.sources.datasource import FitsTables, LightCurves


@pytest.fixture(scope="module")
def formats(spark):
    spark.dataSource.register(LightCurves)
    spark.dataSource.register(FitsTables)
    return spark


def card(key, value):
    text = f"'{value}'".ljust(20) if isinstance(value, str) else ("T" if value is True else str(value)).rjust(20)
    return f"{key:<8}= {text}".ljust(80).encode()


def block(data, fill=b"\0"):
    return data + fill * (-len(data) % 2880)


def fits(columns, rows, cut=0):
    """columns: (name, form, struct letter, extra cards)."""
    primary = block(card("SIMPLE", True) + card("BITPIX", 8) + card("NAXIS", 0) + b"END".ljust(80), b" ")
    packing = ">" + "".join(c[2] for c in columns)
    head = card("XTENSION", "BINTABLE") + card("BITPIX", 8) + card("NAXIS", 2) + card("NAXIS1", struct.calcsize(packing)) + card("NAXIS2", len(rows)) + card("PCOUNT", 0) + card("GCOUNT", 1) + card("TFIELDS", len(columns))
    for k, (name, form, _, extra) in enumerate(columns, 1):
        head += card(f"TTYPE{k}", name) + card(f"TFORM{k}", form) + b"".join(card(f"{key}{k}", v) for key, v in extra.items())
    data = block(b"".join(struct.pack(packing, *r) for r in rows))
    whole = primary + block(head + b"END".ljust(80), b" ") + data
    return whole[: len(whole) - cut] if cut else whole


COLUMNS = [("TIME", "D", "d", {}), ("FLUX", "1E", "f", {}), ("QUALITY", "J", "i", {"TNULL": -1}), ("RAW", "I", "h", {"TSCAL": 0.5, "TZERO": 100.0}), ("NAME", "6A", "6s", {}), ("POS", "2D", "dd", {}), ("GOOD", "L", "B", {})]


def test_fits_tables(formats, tmp_path):
    rows = [(k + 0.25, k / 2, -1 if k % 3 == 0 else k, k, f"n{k}".encode(), k, -k, ord("T") if k % 2 else ord("F")) for k in range(500)]
    (tmp_path / "KIC_1.fits").write_bytes(fits(COLUMNS, rows))
    (tmp_path / "KIC_2.FITS").write_bytes(fits(COLUMNS, rows[:3]))
    df = formats.read.format("fits_table").option("rangeBytes", 2000).load(str(tmp_path))
    assert dict(df.dtypes) == {"series_id": "string", "TIME": "double", "FLUX": "double", "QUALITY": "int", "RAW": "double", "NAME": "string", "POS": "array<double>", "GOOD": "boolean"}
    got = sorted(map(tuple, df.where("series_id = 'KIC_1'").collect()), key=lambda r: r[1])
    assert got == [("KIC_1", r[0], np.float32(r[1]), None if r[2] == -1 else r[2], r[3] * 0.5 + 100, r[4].decode(), [r[5], r[6]], r[7] == ord("T")) for r in rows]
    assert df.count() == 503 and df.rdd.getNumPartitions() > 5
    two = formats.read.format("fits_table").option("columns", "FLUX,TIME").load(str(tmp_path))
    assert two.columns == ["series_id", "FLUX", "TIME"] and two.agg(F.sum("TIME")).first()[0] == sum(r[0] for r in rows + rows[:3])


def test_bad_fits_files_are_named(formats, tmp_path):
    for name, data, message in (("cut", fits(COLUMNS, [(0.0, 0.0, 0, 0, b"", 0, 0, 70)] * 200, 2880 * 2), "truncated table"), ("head", fits(COLUMNS, [])[:4000], "truncated header"), ("none", fits(COLUMNS, [])[:2880], "no binary table 1")):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.fits").write_bytes(data)
        with pytest.raises(Exception, match=message):
            formats.read.format("fits_table").load(str(tmp_path / name)).collect()


def test_light_curve_ranges(formats, tmp_path):
    """Every line is read once, whatever the ranges; filters leave files out; columns are those of the file."""
    (tmp_path / "a.dat").write_text("# c\n" + "".join(f" {k} {k * 2}.5 0.1\n" for k in range(300)) + "7 x 0.1\n8 1\n9 nan 0.1")
    (tmp_path / "b.dat").write_text("1 2\n3 inf\n")
    for size in (7, 100, 10**6):
        df = formats.read.format("lightcurve").option("rangeBytes", size).load(str(tmp_path))
        assert sorted((r["series_id"], r["time"], r["mag"], r["mag_err"]) for r in df.collect()) == [("a", k, k * 2 + 0.5, 0.1) for k in range(300)] + [("b", 1, 2, None), ("b", 3, float("inf"), None)]
    some = lambda names: formats.read.format("lightcurve").option("series", names).load(str(tmp_path))
    assert some("b").count() == 2 and some("b").rdd.getNumPartitions() == 1
    (tmp_path / "c.dat").write_text("1\n")
    with pytest.raises(Exception, match="c.dat: expected 2 or 3 columns"):
        formats.read.format("lightcurve").load(str(tmp_path)).collect()
    assert some("a, b").count() == 302


def test_light_curve_writer(formats, tmp_path):
    rows = [("x", 1.0, 2.5, 0.25), ("x", 2.0, -1.5, 0.5), ("y", 3.0, 0.125, 0.125)]
    df = formats.createDataFrame(rows, "series_id string, time double, mag double, mag_err double")
    out = str(tmp_path / "out")
    (tmp_path / "out").mkdir()
    df.repartition(3).write.format("lightcurve").mode("append").save(out)
    back = formats.read.format("lightcurve").load(out)
    assert sorted(map(tuple, back.collect())) == rows and not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]
    bad = formats.createDataFrame([("ok", 1.0, 1.0, None), ("no/name", 1.0, 1.0, None)], df.schema).repartition(2)
    with pytest.raises(Exception, match="not a name for a file"):
        bad.write.format("lightcurve").mode("append").save(out)
    assert back.count() == 3 and not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]
