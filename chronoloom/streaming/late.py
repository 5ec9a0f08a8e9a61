"""Hourly aggregates of a stream, corrected by late rows: checkpoint and replay per series.

The state of a series is its rows in order of time, as far back as its retention reaches, with a snapshot of the
running count and total after every SPACING rows. A late row restores the snapshot before its place, replays the
sorted suffix and replaces the hours it touched. Rows beyond the cut-off change nothing.
"""

from __future__ import annotations

import bisect
import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronoloom.operators.readings import HOUR_MS

#: Rows between two snapshots.
SPACING = 64
OUT = "series_key string, period_start long, n long, total double, mean double, kind string"


class Replay:
    """Rows of one series in order of time, with snapshots."""

    def __init__(self, last: int | None = None, retention_ms: int | None = None, spacing: int = SPACING) -> None:
        self.last, self.retention, self.spacing = last, retention_ms or 0, spacing
        self.ts: list[int] = []
        self.values: list[float] = []
        #: After i * spacing rows: rows and total of the hour that was open there.
        self.snapshots: list[tuple[int, int, float]] = []
        #: Time tag of each seq that a copy could still change an output by.
        self.seen: dict[int, int] = {}
        self.replayed = 0

    def add(self, seq: int, ts: int, value: float) -> tuple[str, dict[int, tuple[int, float]]]:
        """Class of the row and the outputs it replaces: hour -> (rows, total of the numbers)."""
        if seq in self.seen:
            return "copy", {}
        last = self.last
        if last is not None and self.retention > 0 and last - ts > self.retention:
            return "beyond", {}
        self.seen[seq] = ts
        kind = "correction" if last is not None and ts - ts % HOUR_MS < last - last % HOUR_MS else "on_time"
        self.last = ts if last is None else max(last, ts)
        at = bisect.bisect_right(self.ts, ts)
        self.ts.insert(at, ts)
        self.values.insert(at, value)
        del self.snapshots[at // self.spacing :]  # those behind the new row no longer hold
        return kind, self._replay(ts - ts % HOUR_MS)

    def _replay(self, hour: int) -> dict[int, tuple[int, float]]:
        """Restores the last valid snapshot and replays the rows behind it; the outputs of `hour` are given out."""
        i = len(self.snapshots) * self.spacing
        now, n, total = self.snapshots[-1] if self.snapshots else (None, 0, 0.0)
        found = (n, total) if now == hour else None
        while i < len(self.ts):
            h = self.ts[i] - self.ts[i] % HOUR_MS
            if h != now:
                now, n, total = h, 0, 0.0
            n += 1
            total += 0.0 if math.isnan(self.values[i]) else self.values[i]
            i += 1
            self.replayed += 1
            if h == hour:
                found = (n, total)
            if i % self.spacing == 0:
                self.snapshots.append((now, n, total))
        return {hour: found} if found else {}

    def numbers(self, hour: int) -> int:
        """Rows of an hour that are numbers."""
        lo, hi = bisect.bisect_left(self.ts, hour), bisect.bisect_left(self.ts, hour + HOUR_MS)
        return sum(not math.isnan(v) for v in self.values[lo:hi])

    def forget(self) -> None:
        """Drops rows of hours that no row within the cut-off can touch any more, and what copies of them are known by.

        Copies of such rows are beyond the cut-off themselves. Without a cut-off nothing can be dropped: give series a
        retention where they are to run for long.
        """
        if self.retention <= 0 or self.last is None:
            return
        oldest = self.last - self.retention
        if len(self.seen) > 2 * len(self.ts) + self.spacing:
            self.seen = {s: t for s, t in self.seen.items() if t >= oldest}
        cut = bisect.bisect_left(self.ts, oldest - oldest % HOUR_MS)
        cut -= cut % self.spacing  # whole snapshots, so those that stay keep their places
        if cut:
            del self.ts[:cut], self.values[:cut], self.snapshots[: cut // self.spacing]

    def dump(self) -> str:
        return json.dumps([self.last, self.retention, self.spacing, self.ts, [None if math.isnan(v) else v for v in self.values], self.snapshots, list(self.seen.items())])

    @classmethod
    def load(cls, text: str) -> Replay:
        last, retention, spacing, ts, values, snapshots, seen = json.loads(text)
        out = cls(last, retention, spacing)
        out.ts, out.values = ts, [math.nan if v is None else v for v in values]
        out.snapshots, out.seen = [tuple(s) for s in snapshots], dict(map(tuple, seen))
        return out


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
    if state.exists:
        replay = Replay.load(state.get[0])
    else:
        first = rows.iloc[0]
        replay = Replay(*(None if pd.isna(first[c]) else int(first[c]) for c in ("last_timestamp", "retention_ms")))
    out: dict[int, tuple[int, float, str]] = {}
    for seq, t, v in zip(rows["seq"].tolist(), rows["ts"].tolist(), rows["value"].tolist()):
        kind, hours = replay.add(seq, t, v)
        for h, (n, total) in hours.items():
            out[h] = (n, total, "correction" if kind == "correction" or out.get(h, ("", "", ""))[2] == "correction" else "on_time")
    got = [(key[0], h, n, total, total / k if (k := replay.numbers(h)) else None, kind) for h, (n, total, kind) in sorted(out.items())]
    replay.forget()
    state.update((replay.dump(),))
    if got:
        yield pd.DataFrame(got, columns=["series_key", "period_start", "n", "total", "mean", "kind"])


def corrected_hours(stream: DataFrame, series: DataFrame) -> DataFrame:
    """Hours of a stream of arrivals (series_key, ts, value, seq) that changed with each trigger, in update mode.

    Columns: series_key, period_start, n (rows), total and mean of the numbers, kind (`on_time`, or `correction` if a
    late row replaced the hour). Null values are unreadable; rows with a seq that was seen are copies.
    """
    catalog = series.select("series_key", "last_timestamp", "retention_ms").dropDuplicates(["series_key"])
    rows = stream.where(F.col("value").isNotNull() & F.col("series_key").isNotNull() & F.col("ts").isNotNull() & F.col("seq").isNotNull())
    rows = rows.select("series_key", "ts", "value", "seq").join(catalog, "series_key", "left")
    return rows.groupBy("series_key").applyInPandasWithState(_advance, OUT, "state string", "update", GroupStateTimeout.NoTimeout)
