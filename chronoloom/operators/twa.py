"""Time-weighted average of buckets.

Between two numbers of a series the value is taken to run along a straight line; a bucket's result is the mean of
that line over the part of the bucket that lies in the queried range and between an older and a newer neighbour.
Every sample brings the area up to its left and, where it is the last of its bucket, up to the bucket's end, so
neither a range join nor an expansion of segments over buckets is needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def line_at(t: Column, t0: Column, v0: Column, t1: Column, v1: Column) -> Column:
    """Value at `t` of the line through (t0, v0) and (t1, v1); v1 where both times are equal."""
    return F.when(t1 > t0, v0 + (v1 - v0) * (t - t0) / (t1 - t0)).otherwise(v1)


def area_and_width(ts: Column, v: Column, start: Column, end: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
    """What a sample brings to its bucket [start, end) cut to the range [lo, hi]: area and width.

    Uses the columns prev_ts, prev_v, next_ts, next_v.
    """
    pts, pv, nts, nv = F.col("prev_ts"), F.col("prev_v"), F.col("next_ts"), F.col("next_v")
    ta, tb = F.greatest(start, lo), F.least(end, hi)
    left = F.greatest(pts, ta)
    lv = F.when(pts >= ta, pv).otherwise(line_at(ta, pts, pv, ts, v))
    has_left = pts.isNotNull()
    outside = nts.isNotNull() & ((nts >= end) | (nts > hi))
    rv = line_at(tb, ts, v, nts, nv)
    zero = F.lit(0.0)
    area = F.when(has_left, (lv + v) / 2 * (ts - left)).otherwise(zero) + F.when(outside, (v + rv) / 2 * (tb - ts)).otherwise(zero)
    width = F.when(has_left, (ts - left).cast("double")).otherwise(zero) + F.when(outside, (tb - ts).cast("double")).otherwise(zero)
    return area, width
