"""Streams of observations with state by series: duplicates and late rows go, rows take their order in time, and sums that need the row before are kept.

A stream is (series_id, row_id, t in days, x). A row is late if its time isn't after the watermark, the latest time that earlier triggers saw less the
delay. A row waits until the watermark has passed it, so its place in time is final when it counts; until then a second row of its time and
row_id is known as its duplicate, and afterwards it would be late. So state is the waiting rows and one record of sums a series, whatever the stream's
length. Rows without a finite time and value are passed over; a null series_id is a series; rows of one time go by row_id.

One task has one series' rows of a trigger, which the source's options bound (maxFilesPerTrigger, maxBytesPerTrigger), as three numbers each. What is costly a row (sums by
frequency) goes by partial sums instead, in `latest_moments`, and isn't bound to one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from lumachron.functions.numeric import is_finite
from lumachron.operators.moments import COUNT, STEP, moments

#: What waits, a row each.
WAITING = np.dtype([("t", "<f8"), ("row_id", "<i8"), ("x", "<f8")])
#: Rows whose terms are worked out at once.
AT_ONCE = 4096
DAY = 86_400_000_000


def timed(stream: DataFrame, delay: str) -> DataFrame:
    """stream with `at`, its time as a timestamp, under a watermark; rows without finite time and value are passed over."""
    rows = stream.where(is_finite(F.col("t")) & is_finite(F.col("x"))).select("series_id", F.col("row_id").cast("long").alias("row_id"), "t", F.col("x").cast("double").alias("x"))
    return rows.withColumn("at", F.timestamp_micros(F.round(F.col("t") * DAY).cast("long"))).withWatermark("at", delay)


def micros(t: np.ndarray) -> np.ndarray:
    """The times of `timed`: half a microsecond goes up."""
    scaled = t * DAY
    return np.where(scaled >= 0, np.floor(scaled + 0.5), np.ceil(scaled - 0.5)).astype(np.int64)


def latest_moments(stream: DataFrame, delay: str, count: int = COUNT, step: float = STEP) -> DataFrame:
    """Moments by series and frequency, for update mode: a trigger gives the new sums of the series that it changed. A row counts once, if duplicates come
    within the delay, and late rows don't. Partial sums are taken before rows move; state is a row a series and frequency, and the row ids of the delay."""
    return moments(timed(stream, delay).dropDuplicatesWithinWatermark(["series_id", "row_id"]), count, step)


def newest(updates: DataFrame, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """The last of the updates of each key: that of the greatest n."""
    order = Window.partitionBy(*keys).orderBy(F.desc("n"))
    return updates.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


class Sums:
    """n, mean, deviation and the likelihood's sums by phi of rows so far, in order. Values are taken from the first one, so that a large mean costs no digits.

    A row's term of the likelihood with standardised values is log v + (u - m (1 - p))^2 / (v s^2), u = x - p y, p = phi^gap, v = 1 - p^2, y the value
    before, m and s mean and deviation of all rows; so sums of log v, u^2 / v, u (1 - p) / v and (1 - p)^2 / v by phi do for any m and s.
    """

    def __init__(self, phis: np.ndarray, kept: tuple | None = None):
        self.phis = phis
        if kept is None:
            self.n, self.origin, self.mean, self.squares, self.t, self.x = 0, 0.0, 0.0, 0.0, 0.0, 0.0
            self.terms = np.zeros((4, len(phis)))
        else:
            self.n, self.origin, self.mean, self.squares, self.t, self.x = kept[:6]
            self.terms = np.array(kept[6], float).reshape(4, len(phis))

    def kept(self) -> tuple:
        return (int(self.n), *(float(v) for v in (self.origin, self.mean, self.squares, self.t, self.x)), self.terms.ravel().tolist())

    def add(self, t: np.ndarray, x: np.ndarray) -> None:
        """Rows in order, none before a row that was added."""
        for a in range(0, len(t), AT_ONCE):
            self._add(t[a : a + AT_ONCE], x[a : a + AT_ONCE])

    def _add(self, t: np.ndarray, x: np.ndarray) -> None:
        if self.n == 0:
            self.origin = x[0]
        x = x - self.origin
        gap, y = np.diff(t, prepend=self.t), np.append(self.x, x[:-1])
        use = gap > 0
        use[0] &= self.n > 0
        p = self.phis[:, None] ** gap[use]
        v, u, q = 1 - p * p, x[use] - p * y[use], 1 - p
        self.terms += np.stack([np.log(v).sum(1), (u * u / v).sum(1), (u * q / v).sum(1), (q * q / v).sum(1)])
        m, mean = len(x), x.mean()
        squares = ((x - mean) ** 2).sum()
        self.squares += squares + (mean - self.mean) ** 2 * self.n * m / (self.n + m)
        self.mean += (mean - self.mean) * m / (self.n + m)
        self.n += m
        self.t, self.x = t[-1], x[-1]

    def fit(self) -> tuple:
        """n, mean, sd, phi, nll: the phi of least nll (of equal ones the least). sd, phi and nll are null for one row, phi and nll for equal values."""
        if self.n < 2 or self.squares <= 0:
            return int(self.n), float(self.origin + self.mean), 0.0 if self.n > 1 else None, None, None
        variance = self.squares / (self.n - 1)
        logs, uu, uq, qq = self.terms
        nll = (self.mean**2 / variance + logs + (uu - 2 * self.mean * uq + self.mean**2 * qq) / variance) / 2
        k = int(np.argmin(nll))
        return int(self.n), float(self.origin + self.mean), float(np.sqrt(variance)), float(self.phis[k]), float(nll[k])


class SeriesProcessor(StatefulProcessor):
    """Rows wait in blocks of bytes, as they came; a timer at the least time that waits takes out what the watermark has passed."""

    def __init__(self, count: int):
        self.count = count

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.sums = handle.getValueState("sums", "n bigint, origin double, mean double, squares double, t double, x double, terms array<double>")
        self.phis = np.arange(1, self.count + 1) / float(self.count + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        least = None
        for part in rows:
            block = np.empty(len(part), WAITING)
            for c in WAITING.names:
                block[c] = part[c].to_numpy()
            self.waiting.appendValue((block.tobytes(),))
            first = float(block["t"].min())
            least = first if least is None else min(least, first)
        if least is not None:
            self.wait_for(least)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = np.concatenate([np.empty(0, WAITING), *(np.frombuffer(bytes(r[0]), WAITING) for r in self.waiting.get())])
        due = micros(rows["t"]) <= passed
        left, rows = rows[~due], rows[due]
        self.waiting.clear()
        if len(left):
            self.waiting.appendValue((left.tobytes(),))
            self.wait_for(float(left["t"].min()))
        if not len(rows):
            return
        rows = rows[np.lexsort((rows["x"], rows["row_id"], rows["t"]))]
        rows = rows[np.append(True, (rows["t"][1:] != rows["t"][:-1]) | (rows["row_id"][1:] != rows["row_id"][:-1]))]
        sums = Sums(self.phis, tuple(self.sums.get()) if self.sums.exists() else None)
        sums.add(rows["t"], rows["x"])
        self.sums.update(sums.kept())
        yield pd.DataFrame([(key[0], *sums.fit())], columns=["series_id", "n", "mean", "sd", "phi", "nll"])

    def wait_for(self, t: float) -> None:
        """A timer just past t. A timer more than is needed finds nothing due."""
        self.handle.registerTimer(int(micros(np.array([t]))[0] // 1000 + 1))

    def close(self) -> None:
        pass


def latest_fits(stream: DataFrame, delay: str, count: int = 49) -> DataFrame:
    """series_id, n, mean, sd, phi, nll for update mode: the fit of `autoregression.estimated` (one round) to the rows that the watermark has passed; a trigger gives the
    series that it changed. Of rows of one time and row_id the one of the least x counts. Needs the RocksDB state store."""
    kind = dict(stream.dtypes)["series_id"]
    schema = f"series_id {kind}, n bigint, mean double, sd double, phi double, nll double"
    return timed(stream, delay).groupBy("series_id").transformWithStateInPandas(SeriesProcessor(count), schema, "Update", "EventTime")


def run_available(updates: DataFrame, path: str, checkpoint: str) -> None:
    """Works off what the stream has now and appends each trigger's updates to a Parquet table at path; goes on from the checkpoint where it stopped.

    A trigger that is run again after a failure writes its own folder again, so updates aren't doubled."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    updates.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
