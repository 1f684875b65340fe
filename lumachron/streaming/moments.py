"""Moments of a stream of observations. Sums add up, so a streaming aggregate keeps the spectra of all data so far."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lumachron.operators.moments import COUNT, STEP, moments


def streaming_moments(stream: DataFrame, count: int = COUNT, step: float = STEP) -> DataFrame:
    """Moments by series and frequency of a streaming (series_id, t, x); state is one row each, whatever the stream's length."""
    return moments(stream, count, step)


def start(stream: DataFrame, name: str, checkpoint: str, count: int = COUNT, step: float = STEP) -> StreamingQuery:
    """Keeps the moments in an in-memory table, written whole at each trigger, until stopped."""
    return streaming_moments(stream, count, step).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
