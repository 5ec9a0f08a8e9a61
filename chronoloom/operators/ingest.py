"""Ingest: an arrival log folded into stored samples.

Checks run in this order for each row: readable, retention, near-duplicate suppression, then upsert by the duplicate
policy. What depends on all earlier rows of a series is only the greatest time tag so far, a prefix maximum taken
over blocks of the log; equal time tags are folded per (series, ts), so a hot series is no hot task. Only series with
suppression thresholds need their rows one after another; they pass through a sorted stream of batches that holds one
series' last sample. Without thresholds only a repeat of the last sample is suppressed; rows of its time tag pass through
such a stream by (series, ts).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.model import EngineConfig, catalog
from chronoloom.operators.late import BLOCK
from chronoloom.session import sized_join

LOG = ["series_key", "ts", "value", "seq"]


def _policies(log: DataFrame, series: DataFrame, config: EngineConfig) -> tuple[DataFrame, bool, bool]:
    """Policy of each row (the row's, else the series', else the module's) and options of its series; whether any series has thresholds, a retention."""
    cat = catalog(series).groupBy("series_key").agg(
        F.max("duplicate_policy").alias("_p"), F.max("retention_ms").alias("_ret"), F.max("ignore_max_time_diff").alias("_dt"), F.max("ignore_max_val_diff").alias("_dv")
    )
    # the greatest stored time tag when the log begins, where the catalog has one
    if "last_timestamp" in series.columns:
        reached = series.groupBy("series_key").agg(F.max("last_timestamp").alias("_lt"))
        cat = cat.join(reached, "series_key", "left")
    else:
        cat = cat.withColumn("_lt", F.lit(None).cast("long"))
    own = F.col("on_duplicate") if "on_duplicate" in log.columns else F.lit(None).cast("string")
    some = cat.agg(F.max((F.col("_dt") > 0) | (F.col("_dv") > 0)), F.max(F.col("_ret") > 0)).first()
    rows = sized_join(log.select(*LOG, own.alias("_own")), cat, ["series_key"], "left", salt_of=["seq"])
    policy = F.lower(F.coalesce(F.col("_own"), F.col("_p"), F.lit(config.duplicate_policy)))
    out = rows.select(*LOG, policy.alias("policy"), "_lt", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("_ret", "_dt", "_dv")])
    return out, bool(some[0]), bool(some[1])


def _suppress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Status `ignored` for near duplicates of the last stored sample; rows come sorted by series and arrival."""
    key, last_ts, last_v = None, None, math.nan
    for b in batches:
        out = []
        cols = [b.column(c).to_pylist() for c in ("series_key", "ts", "value", "policy", "_dt", "_dv", "_ret", "_t0", "_v0", "status")]
        for k, t, v, policy, dt, dv, ret, t0, v0, status in zip(*cols):
            if k != key:
                key, last_ts, last_v = k, t0, math.nan if v0 is None else v0
            if status == "unreadable":
                out.append(status)
                continue
            if ret > 0 and last_ts is not None and last_ts - t > ret:
                out.append("rejected")
                continue
            near = policy == "last" and last_ts is not None and t >= last_ts and t - last_ts <= dt and abs(v - last_v) <= dv
            out.append("ignored" if near else "accepted")
            if not near and (last_ts is None or t > last_ts):
                last_ts, last_v = t, v
            elif not near and t == last_ts:
                last_v = merge_values(last_v, v, policy)
        yield b.set_column(b.schema.get_field_index("status"), "status", pa.array(out, pa.string()))


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Status `ignored` for repeats of the last sample; rows come sorted by series, time tag and arrival.

    Only rows marked `_top` share their time tag with such a row; the others are passed on as they are.
    """
    group, held = None, None
    for b in batches:
        status, marked = b.column("status"), np.flatnonzero(b.column("_top").to_numpy(zero_copy_only=False))
        if len(marked):
            out = status.to_pylist()
            some = b.take(pa.array(marked))
            for i, k, t, v, policy, last, t0, v0 in zip(marked.tolist(), *[some.column(c).to_pylist() for c in ("series_key", "ts", "value", "policy", "_last", "_t0", "_v0")]):
                if (k, t) != group:
                    group, held = (k, t), v0 if t0 == t else None
                if out[i] != "accepted":
                    continue
                if policy == "last" and last == t and held is not None and held == v:
                    out[i] = "ignored"
                else:
                    held = v if held is None else merge_values(held, v, policy)
            status = pa.array(out, pa.string())
        yield b.set_column(b.schema.get_field_index("status"), "status", status)


def merge_values(old: float, new: float, policy: str) -> float:
    """Stored value after a row with an equal time tag."""
    one_nan = math.isnan(old) != math.isnan(new)
    if policy == "block":
        return old
    if policy in ("first", "last"):
        return (new if math.isnan(old) else old) if one_nan else (old if policy == "first" else new)
    if one_nan:
        return old
    return old + new if policy == "sum" else min(old, new) if policy == "min" else max(old, new)


def _merge(old: Column, new: Column, policy: Column) -> Column:
    """The same as an expression."""
    one_nan = F.isnan(old) != F.isnan(new)
    kept = policy.isin("first", "last")
    return (
        F.when(policy == "block", old)
        .when(one_nan & kept, F.when(F.isnan(old), new).otherwise(old))
        .when(one_nan, old)
        .when(policy == "first", old)
        .when(policy == "last", new)
        .when(policy == "sum", old + new)
        .when(policy == "min", F.least(old, new))
        .when(policy == "max", F.greatest(old, new))
        .otherwise(old)
    )


def outcomes(log: DataFrame, series: DataFrame, stored: DataFrame | None = None, config: EngineConfig = EngineConfig(), block: int = BLOCK, repeats: bool = True) -> DataFrame:
    """Each row of the log with its policy and status: `unreadable`, `rejected` (beyond retention), `ignored` or `accepted`.

    What a series has reached when the log begins is the greatest time tag of `stored` and the catalog's last_timestamp,
    if there are such. Under the policy `last` a number is ignored if its time tag is not below the last sample's and both
    differences are within the series' thresholds; with thresholds of 0 these are repeats of the last sample. Such repeats
    change no stored sample; with `repeats` False they count as accepted.

    Unreadable rows have no key, no value, no or a negative ts, no seq, or an unknown policy. A row with an accepted status may still
    be refused by the policy `block` if its time tag is taken.
    """
    rows, thresholds, aged = _policies(log, series, config)
    fine = F.col("series_key").isNotNull() & F.col("ts").isNotNull() & (F.col("ts") >= 0) & F.col("value").isNotNull() & F.col("seq").isNotNull() & F.col("policy").isin("block", "first", "last", "min", "max", "sum")
    rows = rows.withColumn("_fine", F.coalesce(fine, F.lit(False)))
    readable = F.when(~F.col("_fine"), "unreadable").otherwise("accepted").alias("status")
    strict = (F.col("_dt") > 0) | (F.col("_dv") > 0)
    parts = []
    if not repeats:  # what has neither thresholds nor a retention depends on no other row
        parts.append(rows.where(~strict & (F.col("_ret") <= 0)).select(*LOG, "policy", readable))
    if stored is not None and (repeats or thresholds or aged):
        base = stored.groupBy("series_key").agg(F.max("ts").alias("_t0"), F.max_by("value", "ts").alias("_v0"))
        rows = sized_join(rows, base, ["series_key"], "left", salt_of=["seq"], once=True)
    else:
        rows = rows.withColumns({"_t0": F.lit(None).cast("long"), "_v0": F.lit(None).cast("double")})
    known = F.col("_lt").isNull() | (F.col("_t0") >= F.col("_lt"))  # else the last sample is one that isn't stored
    rows = rows.withColumns({"_v0": F.when(known, F.col("_v0")), "_t0": F.greatest("_t0", "_lt")})
    if repeats or aged:
        plain = _judged(rows.where(~strict if repeats else ~strict & (F.col("_ret") > 0)), block)
        if repeats:
            top = (F.col("status") == "accepted") & (F.col("policy") == "last") & (F.col("ts") == F.col("_last"))
            plain = plain.withColumn("_top", F.max(F.coalesce(top, F.lit(False))).over(Window.partitionBy("series_key", "ts"))).sortWithinPartitions("series_key", "ts", "seq")
            plain = plain.mapInArrow(_repeats, plain.schema)
        parts.append(plain.select(*LOG, "policy", "status"))
    if thresholds:
        # suppressed rows may not raise the greatest time tag, so the stream keeps it and judges retention itself
        one = rows.where(strict).select(*LOG, "policy", "_dt", "_dv", "_ret", "_t0", "_v0", readable).repartition("series_key").sortWithinPartitions("series_key", "seq")
        parts.append(one.mapInArrow(_suppress, one.schema).select(*LOG, "policy", "status"))
    return reduce(DataFrame.unionByName, parts)


def _judged(rows: DataFrame, block: int) -> DataFrame:
    """`rows` with `_last`, the greatest time tag before each row, and the status by it; rejected rows can't raise it."""
    rows = rows.withColumn("_blk", F.floor(F.col("seq") / F.lit(block)).cast("long"))
    tops = rows.where("_fine").groupBy("series_key", "_blk").agg(F.max("ts").alias("_top"))
    before = Window.partitionBy("series_key").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("series_key", "_blk", F.max("_top").over(before).alias("_old"))
    within = Window.partitionBy("series_key", "_blk").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.join(tops, ["series_key", "_blk"], "left")
    rows = rows.withColumn("_last", F.greatest("_t0", "_old", F.max(F.when(F.col("_fine"), F.col("ts"))).over(within)))
    late = (F.col("_ret") > 0) & (F.col("_last") > F.col("ts")) & (F.col("_last") - F.col("ts") > F.col("_ret"))
    status = F.when(~F.col("_fine"), "unreadable").when(F.coalesce(late, F.lit(False)), "rejected").otherwise("accepted")
    return rows.select(*LOG, "policy", "_t0", "_v0", "_last", status.alias("status"))


def fold(log: DataFrame, series: DataFrame, stored: DataFrame | None = None, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Stored samples (series_key, ts, value) after the log, unique by (series_key, ts).

    `stored` holds the samples from before the log. Rows with equal time tags are merged in order of arrival (of rows
    with the same seq the one of the least value first).
    """
    rows = outcomes(log, series, stored, config, repeats=False).where(F.col("status") == "accepted").select("series_key", "ts", "seq", "value", "policy")
    if stored is not None:
        rows = rows.unionByName(stored.select("series_key", "ts", F.lit(-(1 << 63)).alias("seq"), "value", F.lit("last").alias("policy")))
    each = rows.groupBy("series_key", "ts").agg(F.sort_array(F.collect_list(F.struct("seq", "value", "policy"))).alias("_r"))
    first = F.col("_r")[0]["value"]
    rest = F.slice("_r", 2, F.greatest(F.size("_r") - 1, F.lit(0)))
    return each.select("series_key", "ts", F.when(F.size("_r") == 1, first).otherwise(F.aggregate(rest, first, lambda a, r: _merge(a, r["value"], r["policy"]))).alias("value"))


def fold_plain(rows: DataFrame, policy: str) -> DataFrame:
    """The fast path for rows without NaN under one policy: a single aggregation."""
    v = {"first": F.min_by("value", "seq"), "last": F.max_by("value", "seq"), "min": F.min("value"), "max": F.max("value"), "sum": F.sum("value")}
    if policy not in v:
        raise ValueError("blocked rows have no fast path")
    return rows.groupBy("series_key", "ts").agg(v[policy].alias("value"))


def increments(rows: DataFrame, stored: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """INCRBY and DECRBY: rows (series_key, ts, delta, seq) become samples; each value is the last value plus delta.

    A row whose ts is below the greatest one before it is refused; rows with the same seq count as one. Running sums are taken within blocks of arrivals on
    top of the sums of earlier blocks.
    """
    rows = rows.where(F.col("series_key").isNotNull() & F.col("ts").isNotNull() & F.col("delta").isNotNull() & ~F.isnan("delta"))
    rows = rows.withColumn("_blk", F.floor(F.col("seq") / F.lit(block)).cast("long"))
    base = None
    if stored is not None:
        base = stored.groupBy("series_key").agg(F.max("ts").alias("_t0"), F.max_by("value", "ts").alias("_v0"))
    before = Window.partitionBy("series_key").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("series_key", "_blk").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy("series_key", "_blk").agg(F.max("ts").alias("_top")).select("series_key", "_blk", F.max("_top").over(before).alias("_old"))
    rows = rows.join(tops, ["series_key", "_blk"])
    if base is not None:
        rows = rows.join(base, "series_key", "left").where(F.col("_v0").isNull() | ~F.isnan("_v0"))
    else:
        rows = rows.withColumns({"_t0": F.lit(None).cast("long"), "_v0": F.lit(None).cast("double")})
    last = F.greatest("_t0", "_old", F.max("ts").over(within))
    fine = rows.withColumn("_last", last).where(F.col("_last").isNull() | (F.col("ts") >= F.col("_last")))
    sums = fine.groupBy("series_key", "_blk").agg(F.sum("delta").alias("_s")).select("series_key", "_blk", F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_sum"))
    upto = Window.partitionBy("series_key", "_blk").orderBy("seq").rangeBetween(Window.unboundedPreceding, 0)
    out = fine.join(sums, ["series_key", "_blk"]).withColumn("value", F.coalesce("_v0", F.lit(0.0)) + F.col("_sum") + F.sum("delta").over(upto))
    return out.groupBy("series_key", "ts").agg(F.max_by("value", "seq").alias("value"))


def delete_range(samples: DataFrame, key: str, lo: int, hi: int) -> DataFrame:
    """`samples` without those of a series in [lo, hi]."""
    return samples.where(~((F.col("series_key") == key) & F.col("ts").between(lo, hi)))


def deleted_count(samples: DataFrame, key: str, lo: int, hi: int) -> int:
    """Number of samples that `delete_range` removes."""
    return samples.where((F.col("series_key") == key) & F.col("ts").between(lo, hi)).count()
