"""Downsampling rules kept up to date on a stream.

A bucket closes when its own source sees a later one, not by a global watermark: slow series are not cut by fast
ones. The state of a destination is its open bucket; rows for closed buckets are given out as `late`, and those buckets
are to be made anew from the stored samples. Rules by `twa` give late marks only; their state is the starts of all
buckets with a number so far, one long each.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronoloom.functions.numbers import aggregate_array
from chronoloom.operators import rules as rule_ops
from chronoloom.operators.grid import clean_rules
from chronoloom.session import sized_join

OUT = "dest_key string, ts long, value double, kind string"
STATE = "open long, ts array<long>, value array<double>"


def _start(ts: int, width: int, align: int) -> int:
    return ts - (ts - align) % width


def _marks(key: tuple, rows: pd.DataFrame, state: GroupState) -> list[tuple[str, int, float, str]]:
    """Late marks of the closed buckets of a `twa` rule that the rows change: their own, and those of the numbers beside them."""
    dest, width, align, _ = key
    last, held = (None, []) if not state.exists else (state.get[0], list(state.get[1]))
    changed = set()
    for t, v in zip(rows["ts"].tolist(), rows["value"].tolist()):
        b = int(_start(t, width, align))
        lo, hi = bisect.bisect_left(held, b), bisect.bisect_right(held, b)
        changed.update([b, *held[max(0, lo - 1) : lo], *held[hi : hi + 1]])
        if lo == hi and not math.isnan(v):
            held.insert(lo, b)
        last = b if last is None else max(last, b)
    state.update((last, held, []))
    return [(dest, max(b, 0), math.nan, "late") for b in sorted(changed) if b < last]


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Adds the rows of one trigger to the open bucket, in order of time; closed buckets come out."""
    dest, width, align, agg = key
    rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
    if agg == "twa":
        if marks := _marks(key, rows, state):
            yield pd.DataFrame(marks, columns=["dest_key", "ts", "value", "kind"])
        return
    start, held = (None, {}) if not state.exists else (state.get[0], dict(zip(state.get[1], state.get[2])))
    out = []
    for t, v in zip(rows["ts"].tolist(), rows["value"].tolist()):
        b = _start(t, width, align)
        if start is not None and b < start:
            out.append((dest, max(b, 0), math.nan, "late"))
            continue
        if start is not None and b > start:
            ts = sorted(held)
            value = aggregate_array(agg, np.array(ts), np.array([held[x] for x in ts], float))
            if value is not None:
                out.append((dest, max(start, 0), value, "closed"))
            held = {}
        start = b
        held[t] = v
    ts = sorted(held)
    state.update((start, ts, [float(held[x]) for x in ts]))
    if out:
        yield pd.DataFrame(out, columns=["dest_key", "ts", "value", "kind"])


def compact(stream: DataFrame, rules: DataFrame) -> DataFrame:
    """Closed buckets and late marks of a stream of samples (series_key, ts, value): dest_key, ts, value, kind.

    Of rows with equal time tags in the open bucket the last one counts. Rules by `twa` need neighbours across
    buckets: every closed bucket whose value the trigger made or changed comes out as a late mark only, to be made from
    the stored samples, as `apply_batch` does with the buckets of its batch.
    """
    joined = sized_join(stream.select("series_key", "ts", "value"), clean_rules(rules), ["series_key"])
    return joined.groupBy("dest_key", "bucket_ms", "align_ms", "agg").applyInPandasWithState(_advance, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def apply_batch(load_samples: Callable[[], DataFrame], load_dest: Callable[[], DataFrame], save_dest: Callable[[DataFrame], None], rules: DataFrame):
    """A foreachBatch function for a stream of raw rows: touched buckets are made anew and replaced in the destination."""

    def run(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            save_dest(rule_ops.refresh(load_dest(), load_samples(), rules, batch.select("series_key", "ts")))

    return run
