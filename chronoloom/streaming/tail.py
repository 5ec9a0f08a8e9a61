"""Tail reads that wait for new samples."""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tail(stream: DataFrame, key: str, cursor: int = 0) -> DataFrame:
    """Samples of a series from `cursor` on, as they come."""
    return stream.where((F.col("series_key") == key) & (F.col("ts") >= cursor)).select("ts", "value")


def read_blocking(stream: DataFrame, key: str, cursor: int = 0, least: int = 1, most: int | None = None, timeout_ms: int = 0, checkpoint: str | None = None) -> list[tuple[int, float]]:
    """Waits for `least` samples, at most `timeout_ms` (0: forever), and returns all that came, in order of time.

    `most` is the only cap: with it, no trigger hands more than `most` rows to the driver and the first `most` are
    returned. Without it the answer has every sample of the triggers read, as a list on the driver; `multi.tail_read`
    gives stored samples as a DataFrame. A trigger that a `checkpoint` has as done doesn't come again by it, nor does what
    `most` left of it. If the stream fails before there are enough, its error is raised.
    """
    got: dict[int, float] = {}
    enough = threading.Event()

    def take(batch: DataFrame, _: int) -> None:
        rows = batch.orderBy("ts").limit(most).collect() if most else batch.orderBy("ts").toLocalIterator()
        got.update({r.ts: r.value for r in rows})
        if len(got) >= least:
            enough.set()

    writer = tail(stream, key, cursor).writeStream.foreachBatch(take).trigger(processingTime="200 milliseconds")
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    try:
        end = time.time() + timeout_ms / 1000 if timeout_ms else None
        while not enough.wait(0.1) and query.isActive and (end is None or time.time() < end):
            pass
        if not enough.is_set() and (failed := query.exception()):
            raise failed
    finally:
        query.stop()
    return sorted(list(got.items()))[:most]
