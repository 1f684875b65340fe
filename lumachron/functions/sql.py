"""The library in SQL: scalar functions, a table of frequencies, and the periodogram of the series of a table.

    register(spark)
    SELECT * FROM periodogram(TABLE(s) PARTITION BY (series_id), 200, 0.001D)

A series of the table function is read by one task, in bounded batches, and adds up to a row a frequency; for series that are too long for
one task there are `operators.moments` and `operators.transforms`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: Observations of a batch.
BATCH = 1024


class Periodogram:
    """series_id, freq_id, f, tau, a, b, power of rows (series_id, t, x) at frequencies k * step, k = 1 to count: demeaned and standardised, the
    shift as `operators.moments` has it. Rows whose t or x is null are passed over; a series of one observation has NaN."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, count: AnalyzeArgument, step: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("periodogram needs a table: TABLE(s) PARTITION BY series_id")
        names = {f.name: f.dataType for f in rows.dataType.fields}
        missing = [c for c in ("series_id", "t", "x") if c not in names]
        if missing:
            raise ValueError(f"the table of periodogram has no column {missing[0]}")
        if not isinstance(count.value, int) or count.value < 1:
            raise ValueError("count must be a positive whole number")
        out = StructType().add("series_id", names["series_id"]).add("freq_id", IntegerType())
        for c in ("f", "tau", "a", "b", "power"):
            out = out.add(c, DoubleType())
        return AnalyzeResult(schema=out)

    def __init__(self) -> None:
        self.held: list[tuple[float, float]] = []
        self.sums: np.ndarray | None = None
        self.plain = np.zeros(3)
        self.omega = np.zeros(0)
        self.series, self.step = None, 0.0

    def eval(self, row: Row, count: int, step: float) -> None:
        if self.sums is None:
            self.series, self.step, self.sums = row["series_id"], float(step), np.zeros((6, count))
            self.omega = 2 * math.pi * float(step) * np.arange(1, count + 1)
        if row["t"] is not None and row["x"] is not None:
            self.held.append((float(row["t"]), float(row["x"])))
            if len(self.held) == BATCH:
                self.add()

    def add(self) -> None:
        t, x = np.array(self.held).T
        self.held = []
        if not self.plain[0]:
            self.shift = x[0]
        x = x - self.shift  # squares keep their digits
        z = np.exp(1j * np.outer(self.omega, t))
        one, two, own = z.sum(1), (z * z).sum(1), z @ x
        self.sums += np.stack([one.real, one.imag, two.real, two.imag, own.real, own.imag])
        self.plain += len(t), x.sum(), (x * x).sum()

    def terminate(self) -> Iterator[tuple]:
        if self.held:
            self.add()
        n, sx, sxx = self.plain
        if not n:
            return
        with np.errstate(all="ignore"):
            mean, sd = sx / n, math.sqrt(max(0.0, sxx - sx * sx / n) / (n - 1)) if n > 1 else math.nan
            c1, s1, c2, s2, xc, xs = self.sums
            tau = np.arctan(s2 / c2) / (2 * math.pi)
            yc, ys, ct, st = (xc - mean * c1) / sd, (xs - mean * s1) / sd, np.cos(self.omega * tau), np.sin(self.omega * tau)
            turned = np.cos(2 * self.omega * tau) * c2 + np.sin(2 * self.omega * tau) * s2
            a, b = (ct * yc + st * ys) / np.sqrt(np.maximum((n + turned) / 2, 0)), (st * yc - ct * ys) / np.sqrt(np.maximum((n - turned) / 2, 0))
        for k in range(len(a)):
            yield self.series, k + 1, (k + 1) * self.step, float(tau[k]), float(a[k]), float(b[k]), float((a[k] * a[k] + b[k] * b[k]) / 2)


def register(spark: SparkSession) -> None:
    """Makes ieee_div, freq_grid and periodogram known to the session."""
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION ieee_div(a DOUBLE, b DOUBLE) RETURNS DOUBLE
        RETURN CASE WHEN b <> 0 THEN try_divide(a, b) WHEN a = 0 OR isnan(a) THEN double('NaN') WHEN b = 0 THEN signum(a) * double('Infinity') END"""
    )
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION freq_grid(n INT, step DOUBLE) RETURNS TABLE (freq_id INT, f DOUBLE, omega DOUBLE)
        RETURN SELECT k, k * step, 2 * pi() * k * step FROM (SELECT explode(sequence(1, n)) AS k)"""
    )
    spark.udtf.register("periodogram", udtf(Periodogram))
