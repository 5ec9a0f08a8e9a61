"""Late and out-of-order rows: hourly aggregates by event time, corrected up to a cut-off.

Checkpoint and replay. The arrival log of a series is split into blocks of `seq`; a snapshot of what was reached
before a block comes from block summaries (a prefix maximum over a few rows per series), so a hot series is replayed by
many tasks, none of which sees more than `block` arrivals. Within a block the state is the rows in order of event time
with a checkpoint of the running hour after every SPACING of them. Arrivals are taken a batch at a time: the last
checkpoint before the earliest of them is restored, the sorted suffix behind it is replayed with the new rows in their
places, later checkpoints are made anew, and the outputs of the hours touched are replaced. What the blocks of a
series give for an hour is added up. `chronoloom.streaming.late` keeps such state for unbounded input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.readings import HOUR_MS

#: Arrivals (values of seq) between two snapshots.
BLOCK = 1 << 20
#: Rows in order of event time between two checkpoints.
SPACING = 256
#: Nothing reached yet.
NONE = -(1 << 63)
KINDS = ("on_time", "correction", "beyond")
ROWS = "series_key string, seq long, ts long, value double, period_start long, last long, kind string"
HOURS = "series_key string, period_start long, n long, n_numbers long, total double, n_first long, numbers_first long, total_first double, corrections long, beyond long"


def _log(ingest: DataFrame, block: int) -> DataFrame:
    rows = ingest.select("series_key", F.col("ts").cast("long").alias("ts"), F.col("value").cast("double").alias("value"), F.col("seq").cast("long").alias("seq"))
    rows = rows.where(F.col("series_key").isNotNull() & F.col("ts").isNotNull() & F.col("value").isNotNull() & F.col("seq").isNotNull())
    return rows.withColumn("block", ((F.col("seq") - F.pmod(F.col("seq"), F.lit(block))) / F.lit(block)).cast("long"))


def snapshots(ingest: DataFrame, series: DataFrame, block: int = BLOCK) -> DataFrame:
    """State before each block that has rows: series_key, block, reached (null: nothing seen), retention_ms."""
    tops = _log(ingest, block).groupBy("series_key", "block").agg(F.max("ts").alias("top"))
    before = Window.partitionBy("series_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    catalog = series.where(F.col("series_key").isNotNull()).groupBy("series_key").agg(F.max("last_timestamp").alias("_last"), F.max("retention_ms").alias("retention_ms"))
    seen = tops.select("series_key", "block", F.max("top").over(before).alias("_seen"))
    return seen.join(catalog, "series_key", "left").select("series_key", "block", F.greatest("_seen", "_last").alias("reached"), "retention_ms")


class Ordered:
    """Rows of one series in order of event time, with checkpoints of the running hour."""

    def __init__(self, reached: int | None = None, retention_ms: int | None = None, spacing: int = SPACING) -> None:
        self.retention, self.spacing = retention_ms or 0, spacing
        #: Greatest time tag of rows below the last seq, the last seq, greatest time tag of its rows.
        self.below, self.seq, self.top = NONE if reached is None else reached, None, NONE
        self.ts, self.values = np.zeros(0, np.int64), np.zeros(0)
        #: Rows, numbers and total of the hour of each row, up to and with the row; a checkpoint is its entry at a multiple of `spacing`.
        self.running = np.zeros((3, 0))
        self.log: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.replayed = 0

    def _reached(self, seq: np.ndarray, ts: np.ndarray) -> np.ndarray:
        """The greatest time tag of all rows of a lower seq, for each row."""
        top = np.maximum.accumulate(np.concatenate([[max(self.below, self.top)], ts]))
        first = np.searchsorted(seq, seq)
        out = top[first]
        if seq[0] == self.seq:
            out[seq == self.seq] = self.below
        if seq[-1] == self.seq:
            self.top = max(self.top, int(ts.max()))
        else:
            self.below, self.seq, self.top = int(top[first[-1]]), int(seq[-1]), int(ts[first[-1] :].max())
        return out

    def apply(self, seq: np.ndarray, ts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Takes arrivals in order of seq; hour, what was reached before, and class (a place in KINDS) of each."""
        last, hour = self._reached(seq, ts), ts - ts % HOUR_MS
        some = last != NONE
        lag = last.astype(np.uint64) - ts.astype(np.uint64)
        beyond = some & (self.retention > 0) & (last > ts) & (lag > np.uint64(max(0, self.retention)))
        kind = np.where(beyond, 2, (some & (hour < last - last % HOUR_MS)).astype(np.int64))
        self.log.append((hour, kind, values))
        self._merge(ts[~beyond], values[~beyond])
        return hour, last, kind

    def _merge(self, ts: np.ndarray, values: np.ndarray) -> None:
        """Restores the checkpoint before the earliest new row and replays the sorted suffix with the new rows in it."""
        if not len(ts):
            return
        order = np.argsort(ts, kind="stable")
        ts, values = ts[order], values[order]
        at = int(np.searchsorted(self.ts, ts[0], "right"))
        at -= at % self.spacing
        places = np.searchsorted(self.ts[at:], ts, "right")
        t, v = np.insert(self.ts[at:], places, ts), np.insert(self.values[at:], places, values)
        hour = t - t % HOUR_MS
        starts = np.flatnonzero(np.concatenate([[True], hour[1:] != hour[:-1]]))
        real = ~np.isnan(v)
        new = np.cumsum([np.ones(len(t)), real, np.where(real, v, 0.0)], axis=1)
        if at and self.ts[at - 1] - self.ts[at - 1] % HOUR_MS == hour[0]:  # the hour began before the checkpoint
            new += self.running[:, at - 1 : at]
        lengths = np.diff(np.append(starts, len(t)))
        lead = np.zeros((3, len(starts)))
        lead[:, 1:] = new[:, starts[1:] - 1]
        new -= np.repeat(lead, lengths, axis=1)
        self.ts, self.values = np.concatenate([self.ts[:at], t]), np.concatenate([self.values[:at], v])
        self.running = np.concatenate([self.running[:, :at], new], axis=1)
        self.replayed += len(t)

    def outputs(self) -> tuple[np.ndarray, np.ndarray]:
        """Hours and their rows, numbers and total, as they stand."""
        hour = self.ts - self.ts % HOUR_MS
        ends = np.flatnonzero(np.append(hour[1:] != hour[:-1], True)) if len(hour) else np.zeros(0, np.int64)
        return hour[ends], self.running[:, ends]


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Ordered, pa.RecordBatch | None]]:
    """States and the rows to apply to each, in order; None closes a state. A row without seq is the snapshot that opens one."""
    state, key = None, None
    for b in batches:
        opens = np.append(np.flatnonzero(pc.is_null(b.column("seq")).to_numpy(zero_copy_only=False)), len(b))
        if state is not None and opens[0] > 0:
            yield key, state, b.slice(0, opens[0])
        for lo, hi in zip(opens[:-1].tolist(), opens[1:].tolist()):
            if state is not None:
                yield key, state, None
            key, state = b.column("series_key")[lo].as_py(), Ordered(b.column("ts")[lo].as_py(), b.column("retention_ms")[lo].as_py())
            if hi > lo + 1:
                yield key, state, b.slice(lo + 1, hi - lo - 1)
    if state is not None:
        yield key, state, None


def _apply(state: Ordered, rows: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    seq, ts, values = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("seq", "ts", "value"))
    return (seq, ts, values, *state.apply(seq, ts, values))


def _emit_rows(kinds: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    wanted = [KINDS.index(k) for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            keys = pa.array([k for k, *_ in held], pa.string()).take(pa.array(np.repeat(np.arange(len(held)), [len(x[1]) for x in held])))
            seq, ts, values, hour, last, kind = (np.concatenate(x) for x in list(zip(*held))[1:])
            cols = [keys, pa.array(seq), pa.array(ts), pa.array(values, from_pandas=False), pa.array(hour), pa.array(last, mask=last == NONE), pa.array(KINDS).take(pa.array(kind))]
            return pa.RecordBatch.from_arrays(cols, names=["series_key", "seq", "ts", "value", "period_start", "last", "kind"])

        size = 0
        for key, state, rows in _states(batches):
            if rows is None:
                continue
            got = _apply(state, rows)
            mine = np.isin(got[-1], wanted)
            if mine.any():
                held.append((key, *(x[mine] for x in got)))
                size += int(mine.sum())
            if size >= 20_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def _emit_hours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        keys = pa.array([k for k, *_ in held], pa.string()).take(pa.array(np.repeat(np.arange(len(held)), [len(x[1]) for x in held])))
        cols = [np.concatenate(x) for x in list(zip(*held))[1:]]
        return pa.RecordBatch.from_arrays([keys, *map(pa.array, cols)], names=["series_key", "period_start", "n", "n_numbers", "total", "n_first", "numbers_first", "total_first", "corrections", "beyond"])

    size = 0
    for key, state, rows in _states(batches):
        if rows is not None:
            _apply(state, rows)
            continue
        if not state.log:
            continue
        hour, kind, values = (np.concatenate(x) for x in zip(*state.log))
        hours, at = np.unique(hour, return_inverse=True)
        count = lambda mask: np.bincount(at[mask], minlength=len(hours))  # noqa: B023, E731
        first, real = kind == 0, ~np.isnan(values)
        out = np.zeros((3, len(hours)))
        touched, outputs = state.outputs()
        out[:, np.searchsorted(hours, touched)] = outputs
        firsts = np.bincount(at[first & real], weights=values[first & real], minlength=len(hours))
        held.append((key, hours, out[0].astype(np.int64), out[1].astype(np.int64), out[2], count(first), count(first & real), firsts, count(kind == 1), count(kind == 2)))
        size += len(hours)
        if size >= 20_000:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _in_order(ingest: DataFrame, series: DataFrame, block: int) -> DataFrame:
    """The distinct rows of the log by (series, block) in order of seq, each block behind its snapshot (a row without seq)."""
    none = F.lit(None)
    rows = _log(ingest, block).select("series_key", "block", "seq", "ts", "value", none.cast("long").alias("retention_ms"))
    opens = snapshots(ingest, series, block).select("series_key", "block", none.cast("long").alias("seq"), F.col("reached").alias("ts"), none.cast("double").alias("value"), "retention_ms")
    return rows.unionByName(opens).repartition("series_key", "block").distinct().sortWithinPartitions("series_key", "block", F.asc_nulls_first("seq"), "ts", "value")


def replay(ingest: DataFrame, series: DataFrame, block: int = BLOCK, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Every row of the log with what was reached before it and its class, or those of some `kinds` only.

    Columns: series_key, seq, ts, value, period_start (UTC hour of ts), last, kind: `on_time` (its hour had not
    passed), `correction` (its hour had passed, within the cut-off: its hour's output is replaced) or `beyond` (past the
    cut-off: nothing is replaced).

    Rows with a null key, time, value or seq are unreadable and are left out; NaN is a value. Exact copies (same
    series, seq, ts and value) count once. Rows of a series that share a seq see only rows of a lower seq.
    """
    return _in_order(ingest, series, block).mapInArrow(_emit_rows(tuple(kinds)), ROWS)


def corrections(ingest: DataFrame, series: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows that correct an hour already passed: seq, period_start."""
    return replay(ingest, series, block, ("correction",)).select("seq", "period_start").distinct()


def corrected_hours(ingest: DataFrame, series: DataFrame, block: int = BLOCK) -> DataFrame:
    """Hourly aggregates: as first given out, and as replaced by late rows within the cut-off.

    Columns: series_key, period_start, n (rows), n_numbers (rows that are not NaN), total and mean of the numbers
    (null without any), n_first and total_first (rows on time only), corrections and beyond (rows of either kind).
    Hours whose rows are all beyond the cut-off have n 0.
    """
    parts = _in_order(ingest, series, block).mapInArrow(_emit_hours, HOURS)
    whole = ("n", "n_numbers", "total", "n_first", "numbers_first", "total_first", "corrections", "beyond")
    out = parts.groupBy("series_key", "period_start").agg(*[F.sum(c).alias(c) for c in whole])
    total, first = F.when(F.col("n_numbers") > 0, F.col("total")), F.when(F.col("numbers_first") > 0, F.col("total_first"))
    return out.withColumns({"total": total, "total_first": first}).drop("numbers_first").withColumn("mean", F.col("total") / F.col("n_numbers"))
