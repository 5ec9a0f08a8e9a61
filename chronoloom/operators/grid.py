"""Irregular readings onto a regular grid, one grid per downsampling rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.neighbours import with_neighbours
from chronoloom.operators.readings import TASK_ROWS, floor_to, numbers
from chronoloom.operators.twa import area_and_width
from chronoloom.session import checkpointed, is_bounded, sized_join

#: Periods of a block at most, and entries of any array that makes periods or blocks; bounds the work of a step, not the result.
STEP = 4096
#: Width of a block of periods; a wider period is a block of its own.
BLOCK_MS = 4 * 86_400_000
#: 72 hours.
MAX_GAP_MS = 259_200_000
#: Stands for "no older reading" where a time is needed.
NEVER = -(1 << 62)


def clean_rules(rules: DataFrame, *more: str) -> DataFrame:
    """Distinct rules with a source, a destination and a positive bucket; agg in lower case, align 0 for null; columns `more` where there are."""
    return (
        rules.where(F.col("source_key").isNotNull() & F.col("dest_key").isNotNull() & (F.col("bucket_ms") > 0))
        .select(
            F.col("source_key").alias("series_key"),
            "dest_key",
            F.coalesce(F.lower(F.trim("agg")), F.lit("")).alias("agg"),
            F.col("bucket_ms").cast("long").alias("bucket_ms"),
            F.coalesce(F.col("align_ms").cast("long"), F.lit(0).cast("long")).alias("align_ms"),
            *[F.col(c) for c in more if c in rules.columns],
        )
        .distinct()
    )


def _with_rules(rows: DataFrame, rules: DataFrame, on: str, fits: bool, salt_of: str) -> DataFrame:
    """`rows` joined with a part of the rules; `fits` tells that all of them are within the bounds of a broadcast."""
    return rows.join(F.broadcast(rules), on) if fits else sized_join(rows, rules, [on], salt_of=[salt_of])


def _placed(samples: DataFrame, rules: DataFrame, fits: bool) -> DataFrame:
    """Stored numbers by each rule of their series: rule, at (start of the block), period, bucket_ms, ts, value."""
    rows = _with_rules(numbers(samples), rules.select("series_key", "rule", "bucket_ms", "align_ms", "span_ms"), "series_key", fits, "ts")
    at, period = floor_to(F.col("ts"), F.col("span_ms"), F.col("align_ms")), floor_to(F.col("ts"), F.col("bucket_ms"), F.col("align_ms"))
    return rows.select("rule", at.alias("at"), period.alias("period"), "bucket_ms", "ts", "value")


def _ends(rows: DataFrame) -> DataFrame:
    """Per rule and block with readings: n (stored rows) and the ends, each with the greatest value of its time tag."""
    point = lambda t: F.struct(t.alias("t"), F.col("value").alias("v"))
    out = rows.groupBy("rule", "at").agg(F.count("*").alias("n"), F.max(point(-F.col("ts"))).alias("f"), F.max(point(F.col("ts"))).alias("l"))
    return out.select("rule", "at", "n", F.struct((-F.col("f.t")).alias("t"), F.col("f.v").alias("v")).alias("first"), F.col("l").alias("last"))


def _steps(lo: Column, hi: Column, width: Column) -> tuple[Column, Column]:
    """lo, lo + width … hi in two explodes of bounded arrays: starts of steps (to be named `_s`), then their entries."""
    leap = width * STEP
    return F.explode(F.sequence(lo, hi, leap)), F.explode(F.sequence("_s", F.least(hi, F.col("_s") + leap - width), width))


def _blocks(ends: DataFrame, rules: DataFrame) -> DataFrame:
    """The sequence of periods, block by block, those without readings included.

    Columns: rule, at, lo and hi (first and last period to come out), bucket_ms, and the readings around the block:
    prev (t, v) and next (t, v), null where there is none.
    """
    spans = ends.groupBy("rule").agg(F.min("at").alias("_lo"), F.max("at").alias("_hi"), F.min("first.t").alias("_t0"), F.max("last.t").alias("_t1"))
    spans = spans.join(rules.select("rule", "bucket_ms", "align_ms", "span_ms"), "rule")  # a row per rule on either side
    outer, inner = _steps(F.col("_lo"), F.col("_hi"), F.col("span_ms"))
    every = spans.withColumn("_s", outer).withColumn("at", inner).join(ends.select("rule", "at", "first", "last"), ["rule", "at"], "left")
    w = Window.partitionBy("rule").rowsBetween(Window.unboundedPreceding, -1)
    first, last = (floor_to(F.col(c), F.col("bucket_ms"), F.col("align_ms")) for c in ("_t0", "_t1"))
    return every.select(
        "rule", "at", "bucket_ms", F.greatest("at", first).alias("lo"), F.least(F.col("at") + F.col("span_ms") - F.col("bucket_ms"), last).alias("hi"),
        F.last("last", True).over(w.orderBy("at")).alias("prev"), F.last("first", True).over(w.orderBy(F.desc("at"))).alias("next"),
    )


def _with_points(rows: DataFrame, hot: bool) -> DataFrame:
    """For the time-weighted average: one row per time tag, with prev_ts, prev_v, next_ts, next_v; `k` counts its readings.

    The row of a block stands for the reading before the block, a second one for the reading behind it.
    """
    rows = rows.groupBy("rule", "at", "period", "hi", "bucket_ms", "ts", "next").agg(F.max("value").alias("value"), F.count("*").alias("k"))
    block = F.col("hi").isNotNull()
    own = F.struct(F.lit(True).alias("keep"), F.coalesce("ts", F.lit(NEVER)).alias("ts"), "value")
    behind = F.struct(F.lit(False).alias("keep"), F.col("next.t").alias("ts"), F.col("next.v").alias("value"))
    rows = rows.withColumn("_p", F.explode(F.when(block & F.col("next").isNotNull(), F.array(own, behind)).otherwise(F.array(own))))
    rows = rows.select("rule", "at", "period", "hi", "bucket_ms", "next", "k", "_p.*")
    if hot:
        near = with_neighbours(rows, ["rule", "at"], F.lit(BLOCK_MS // 1024))
    else:
        w = Window.partitionBy("rule", "at").orderBy("ts")
        near = rows.withColumns({f"{a}_{c}": f(c0).over(w) for a, f in (("prev", F.lag), ("next", F.lead)) for c, c0 in (("ts", "ts"), ("v", "value"))})
    real = F.col("prev_ts") != NEVER
    return near.where("keep").withColumns({"prev_ts": F.when(real, F.col("prev_ts")), "prev_v": F.when(real, F.col("prev_v")), "ts": F.when(F.col("ts") != NEVER, F.col("ts"))})


def _filled(placed: DataFrame, blocks: DataFrame, twa: bool, hot: DataFrame | None, max_gap_ms: int) -> DataFrame:
    """All periods of the rules of `blocks` with what their readings give, and the older reading carried forward.

    Readings and blocks go through one shuffle by (rule, block). Behind it the rows of a block give its periods and those
    of readings join them there; with `hot` the readings of the blocks named in it are spread by a salt as well.
    """
    blank = lambda kind: F.lit(None).cast(kind)
    point = "struct<t:bigint,v:double>"
    data = placed.select("rule", "at", "period", "ts", "value", blank("long").alias("hi"), F.col("bucket_ms") if twa else blank("long").alias("bucket_ms"), blank(point).alias("next"), *(["_k"] if hot is not None else []))
    steps = blocks.select("rule", "at", F.col("lo").alias("period"), F.col("prev.t").alias("ts"), F.col("prev.v").alias("value"), "hi", "bucket_ms", "next", *([F.lit(1).cast("long").alias("_k")] if hot is not None else []))
    rows = data.unionByName(steps)
    if hot is None:
        rows = rows.repartition("rule", "at").distinct()
    else:
        salt = F.pmod(F.xxhash64("ts"), F.col("_k"))
        rows = rows.withColumn("_salt", salt).drop("_k").repartition("rule", "at", "_salt").distinct().drop("_salt")
    rows = _with_points(rows, hot is not None) if twa else rows.withColumn("k", F.lit(1))
    block = F.col("hi").isNotNull()
    ts, v = F.when(~block, F.col("ts")), F.when(~block, F.col("value"))
    span = F.explode(F.when(block, F.sequence("period", "hi", "bucket_ms")).otherwise(F.array("period")))
    parts = {"_t": ts, "_v": v, "_pt": F.when(block, F.col("ts")), "_pv": F.when(block, F.col("value")), "_nt": F.col("next.t")}
    if twa:
        start, far = F.col("period"), F.lit(1 << 62)
        area, width = area_and_width(F.col("ts"), F.col("value"), start, start + F.col("bucket_ms"), -far, far)
        parts |= {"_a": F.when(~block, area), "_w": F.when(~block, width)}
    rows = rows.select("rule", "at", span.alias("period_start"), F.when(~block, F.col("k")).alias("k"), *[c.alias(n) for n, c in parts.items()])
    here = lambda t: F.max(F.when(F.col("_t").isNotNull(), F.struct(t.alias("t"), F.col("_v").alias("v"))))
    aggs = [
        F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("n"), here(-F.col("_t")).alias("first"), here(F.col("_t")).alias("last"),
        F.max("_pt").alias("_pt"), F.max("_pv").alias("_pv"), F.max("_nt").alias("_nt"),
    ]
    if twa:
        aggs.append(F.when(F.sum("_w") > 0, F.sum("_a") / F.sum("_w")).alias("twa"))
        aggs += [blank("double").alias(c) for c in ("total", "least", "greatest", "spread")]
    else:
        aggs += [blank("double").alias("twa"), F.sum("_v").alias("total"), F.min("_v").alias("least"), F.max("_v").alias("greatest"), F.var_pop("_v").alias("spread")]
    periods = rows.groupBy("rule", "at", "period_start").agg(*aggs)
    w = Window.partitionBy("rule", "at").rowsBetween(Window.unboundedPreceding, 0)
    up, down = w.orderBy("period_start"), w.orderBy(F.desc("period_start"))
    carried = F.last("last", True).over(up)
    # the next reading is the last one so far in reversed order, a frame that costs one step a row
    seen = periods.withColumns({"_c": carried, "_next": F.coalesce(-F.last("first", True).over(down)["t"], "_nt")})
    seen = seen.withColumns({"_prev": F.coalesce("_c.t", "_pt"), "_carry": F.when(F.col("_c").isNotNull(), F.col("_c.v")).otherwise(F.col("_pv"))})
    read = F.col("n") > 0
    gap = F.when(~read, F.col("_next") - F.col("_prev"))
    state = F.when(read, "read").when(gap <= max_gap_ms, "filled").otherwise("missing")
    return seen.select("rule", "period_start", "n", "twa", "total", "least", "greatest", "spread", F.col("first.v").alias("first"), F.col("last.v").alias("last"), "_carry", gap.alias("gap_ms"), state.alias("state"))


def _value(agg: Column) -> Column:
    """A read period's value by the rule's aggregator, out of what its readings give."""
    n, var = F.col("n").cast("double"), F.col("spread")
    sample = F.when(n > 1, var * n / (n - 1)).otherwise(0.0)
    by = {
        "min": F.col("least"), "max": F.col("greatest"), "sum": F.col("total"), "avg": F.col("total") / n, "count": n, "countall": n, "countnan": F.lit(0.0), "first": F.col("first"),
        "last": F.col("last"), "range": F.col("greatest") - F.col("least"), "var.p": var, "std.p": F.sqrt(var), "var.s": sample, "std.s": F.sqrt(sample), "twa": F.coalesce("twa", "last"),
    }
    out = F.lit(None).cast("double")
    for name, c in by.items():
        out = F.when(agg == name, c).otherwise(out)
    return out


def regular_grid(samples: DataFrame, rules: DataFrame, max_gap_ms: int = MAX_GAP_MS, task_rows: int = TASK_ROWS) -> DataFrame:
    """One row for every bucket of a rule between its source's first and last reading.

    Method: a sequence of periods per rule, left join of the bucket-aggregated readings, last observation carried
    forward where the neighbouring readings are at most `max_gap_ms` apart, the rest marked as missing. Sequence and
    readings are cut into blocks of periods, so they meet in one shuffle by (rule, block) and no task has all periods of
    a rule; readings around a block come from a table of the blocks' ends. A block of more than `task_rows` stored
    rows is spread over several tasks.

    Columns: dest_key, bucket_ms, period_start, state (`read`, `filled` or `missing`), gap_ms (time between the
    readings around an unread period, else null), n (readings), value (by the rule's aggregator where read, the
    last reading where filled, null where missing).

    Rules that repeat count once; rules without a key, destination or positive bucket and rules whose source has
    no reading give no rows; an unknown aggregator gives null values. Rows of samples without key, time or number
    are no readings. Of readings with equal time tags the greatest value stands for all as the first, the last and
    on the line of the time-weighted average.
    """
    rules = clean_rules(rules)
    span = F.col("bucket_ms") * F.greatest(F.lit(1), F.least(F.lit(STEP), F.floor(F.lit(BLOCK_MS) / F.col("bucket_ms"))))
    # rows between the steps carry a number for their rule in place of its names; it is fixed by the checkpoint
    rules = checkpointed(rules.withColumns({"rule": F.monotonically_increasing_id(), "span_ms": span.cast("long")}))
    fits = is_bounded(rules)
    ends = checkpointed(_ends(_placed(samples, rules, fits)))
    hot = ends.where(F.col("n") > task_rows).select("rule", "at", F.ceil(F.col("n") / F.lit(task_rows)).alias("_k"))
    spread = not hot.isEmpty()
    out = None
    for twa in (False, True):
        own = rules.where((F.col("agg") == "twa") == twa)
        if own.isEmpty():
            continue
        blocks = _blocks(ends.join(own.select("rule"), "rule", "left_semi"), own)
        placed = _placed(samples, own, fits)
        parts = [(placed, blocks, None)]
        if spread:
            marked = sized_join(placed, hot, ["rule", "at"], "left", salt_of=["ts"])
            mine = lambda how: blocks.join(hot.select("rule", "at"), ["rule", "at"], how)  # noqa: B023, E731
            parts = [(marked.where("_k is null"), mine("left_anti"), None), (marked.where("_k is not null"), mine("left_semi"), hot)]
        for p, b, h in parts:
            one = _filled(p, b, twa, h, max_gap_ms)
            out = one if out is None else out.unionByName(one)
    if out is None:
        out = _filled(_placed(samples, rules, fits), _blocks(ends, rules), False, None, max_gap_ms)
    out = _with_rules(out, rules.select("rule", "dest_key", "bucket_ms", "agg"), "rule", fits, "period_start")
    value = F.when(F.col("state") == "read", _value(F.col("agg"))).when(F.col("state") == "filled", F.col("_carry"))
    return out.select("dest_key", "bucket_ms", "period_start", "state", "gap_ms", "n", "agg", value.alias("value"))


def fillable_periods(samples: DataFrame, rules: DataFrame, max_gap_ms: int = MAX_GAP_MS) -> DataFrame:
    """Unread periods between readings at most `max_gap_ms` apart, which a carried value fills: dest_key, period_start."""
    g = regular_grid(samples, rules, max_gap_ms)
    return g.where((F.col("state") == "filled") & F.col("value").isNotNull()).select("dest_key", "period_start").distinct()
