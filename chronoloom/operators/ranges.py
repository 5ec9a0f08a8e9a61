"""Range scans and bucketed aggregation over one or many series."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.aggregates import accepted, aggregate, filled, number
from chronoloom.model import MAX_TS, TimeSeries, catalog
from chronoloom.operators.neighbours import with_neighbours
from chronoloom.operators.readings import floor_to
from chronoloom.operators.twa import area_and_width, line_at
from chronoloom.plans.specs import Buckets, RangeSpec
from chronoloom.session import sized_join

#: Buckets that one step of the gap filling makes at a time.
STEP = 4096


def value_columns(n: int) -> list[str]:
    return ["value", *[f"value_{i}" for i in range(2, n + 1)]]


def kept_rows(ts: TimeSeries, selected: DataFrame, spec: RangeSpec, single: bool = False) -> DataFrame:
    """Samples of the selected series that retention and the filters keep, with `lo`, the start of the series' range.

    Rows outside of the range stay only where gap filling or the time-weighted average need neighbours.
    """
    b = spec.buckets
    outside = b is not None and (b.empty or "twa" in b.names)
    cat = catalog(selected)
    aged = cat.where(F.col("retention_ms") > 0).select("series_key", "retention_ms") if spec.retention else None
    if aged is not None and aged.isEmpty():
        aged = None
    # neighbours and retention look beyond the range; else the scan is pruned to it
    rows = ts.samples.select("series_key", "ts", "value") if outside or aged is not None or spec.latest else ts.between(spec.start, spec.end)
    if spec.latest:
        from chronoloom.operators.rules import open_buckets

        rows = rows.unionByName(open_buckets(ts, selected))
    if not single:
        rows = sized_join(rows, cat.select("series_key").distinct(), ["series_key"], "left_semi")
    lo = F.lit(spec.start)
    if aged is not None:
        last = sized_join(rows, aged.select("series_key"), ["series_key"], "left_semi").groupBy("series_key").agg(F.max("ts").alias("_last"))
        oldest = last.join(aged, "series_key").select("series_key", F.when(F.col("_last") > F.col("retention_ms"), F.col("_last") - F.col("retention_ms")).alias("_oldest"))
        rows = sized_join(rows, oldest, ["series_key"], "left", once=True).where(F.col("_oldest").isNull() | (F.col("ts") >= F.col("_oldest")))
        lo = F.greatest(lo, F.col("_oldest"))
    rows = rows.withColumn("lo", lo)
    if not outside:
        rows = rows.where(F.col("ts").between(spec.start, spec.end))
    if spec.times is not None:
        rows = rows.where(F.col("ts").isin(*spec.times) if spec.times else F.lit(False))
    if spec.values is not None:
        rows = rows.where(F.col("value").between(*spec.values) & ~F.isnan("value"))
    return rows.select("series_key", "ts", "value", "lo")


def _start(b: Column) -> Column:
    """Bucket starts before 0 read as 0."""
    return F.greatest(b, F.lit(0).cast("long"))


def _label(b: Column, spec: Buckets) -> Column:
    return _start(b) + {"start": 0, "mid": spec.width // 2, "end": spec.width}[spec.label]


def bucketed(kept: DataFrame, spec: RangeSpec) -> DataFrame:
    """Bucket aggregates: series_key, ts (bucket label), value, value_2 …"""
    bk = spec.buckets
    names, d = bk.names, bk.width
    cols = value_columns(len(names))
    twa = "twa" in names
    bucket = floor_to(F.col("ts"), d, spec.align)
    rows = kept
    if twa:
        plain = kept.where(F.isnan("value")).select("series_key", "ts", "value", "lo", *[F.lit(None).cast(t).alias(c) for c, t in (("_a", "double"), ("_w", "double"))])
        near = with_neighbours(kept.where(~F.isnan("value")), ["series_key"])
        near = near.withColumn("_b", bucket).where((F.col("ts") >= F.col("lo")) & (F.col("ts") <= spec.end))
        area, width = area_and_width(F.col("ts"), F.col("value"), F.col("_b"), F.col("_b") + d, F.col("lo"), F.lit(spec.end))
        rows = near.select("series_key", "ts", "value", "lo", area.alias("_a"), width.alias("_w")).unionByName(plain)
    inside = rows.where((F.col("ts") >= F.col("lo")) & (F.col("ts") <= spec.end)).withColumn("_b", bucket)
    v, t = F.col("value"), F.col("ts")
    some = number(v)
    carried = "last" in names or twa
    mixed = any(n in ("countnan", "countall") for n in names) and len(names) > 1
    aggs = []
    for c, n in zip(cols, names):
        if n == "twa":
            e = F.when(F.sum("_w") > 0, F.sum("_a") / F.sum("_w")).otherwise(F.max_by(some, F.when(some.isNotNull(), t)))
        else:
            e = aggregate(n, v, t)
        aggs.append(e.alias(c))
    aggs.append(accepted(list(names), v).alias("_ok"))
    extra = carried and (bk.empty or mixed)
    if extra:
        real = F.when(some.isNotNull(), t)
        aggs += [F.min(real).alias("_ft"), F.min_by(some, real).alias("_fv"), F.max(real).alias("_lt"), F.max_by(some, real).alias("_lv")]
    groups = inside.groupBy("series_key", "_b").agg(*aggs)
    if not bk.empty:
        groups = groups.where("_ok")
        out = _carry(groups, None, spec) if extra else groups
    else:
        out = _carry(*_with_gaps(kept, groups, spec), spec) if extra else _with_gaps(kept, groups, spec)[0]
    return out.select("series_key", _label(F.col("_b"), bk).alias("ts"), *[filled(n, F.col(c)).alias(c) for c, n in zip(cols, names)])


def _with_gaps(kept: DataFrame, groups: DataFrame, spec: RangeSpec) -> tuple[DataFrame, DataFrame]:
    """`groups` with a row for each missing bucket that is to be given out, and each series' neighbours outside."""
    d, t, v = spec.buckets.width, F.col("ts"), number(F.col("value"))
    real = F.when(v.isNotNull(), t)
    older, newer = F.when(t < F.col("lo"), real), F.when(t > spec.end, real)
    inside = (t >= F.col("lo")) & (t <= spec.end)
    bucket = floor_to(t, d, spec.align)
    ends = kept.groupBy("series_key", "lo").agg(
        F.min(real).alias("_n0"), F.max(real).alias("_n1"),
        F.max(older).alias("_ot"), F.max_by(v, older).alias("_ov"), F.min(newer).alias("_nt"), F.min_by(v, newer).alias("_nv"),
        F.min(F.when(inside, bucket)).alias("_b0"), F.max(F.when(inside, bucket)).alias("_b1"),
    )
    lo = F.col("lo")
    from_b = floor_to(lo, d, spec.align)
    to_b = floor_to(F.lit(spec.end), d, spec.align) if spec.end < MAX_TS else F.col("_b1")
    before_all = F.coalesce((F.col("_n0") < lo) & (F.col("_n1") >= lo), F.lit(False))
    after = F.col("_b1") + d
    behind = F.coalesce((F.col("_n0") < after) & (F.col("_n1") >= after), F.lit(False)) if spec.end < MAX_TS else F.lit(False)
    none = F.col("_b0").isNull()
    first = F.when(before_all, from_b).otherwise(F.col("_b0"))
    last = F.when(none & before_all, to_b).when(behind, F.greatest(to_b, F.col("_b1"))).otherwise(F.col("_b1"))
    spans = ends.withColumns({"_first": first, "_last": last}).where(F.col("_first").isNotNull() & F.col("_last").isNotNull() & (F.col("_first") <= F.col("_last")))
    leap = d * STEP
    steps = spans.select("series_key", "_last", F.explode(F.sequence("_first", "_last", F.lit(leap).cast("long"))).alias("_at"))
    grid = steps.select("series_key", F.explode(F.sequence("_at", F.least(F.col("_last"), F.col("_at") + (leap - d)), F.lit(d).cast("long"))).alias("_b"))
    return grid.join(groups, ["series_key", "_b"], "left"), ends.select("series_key", "lo", "_ot", "_ov", "_nt", "_nv")


def _carry(rows: DataFrame, ends: DataFrame | None, spec: RangeSpec) -> DataFrame:
    """Fills `last` and `twa` of buckets without a number from the neighbouring ones."""
    bk = spec.buckets
    if ends is not None:
        rows = rows.join(ends, "series_key", "left")
    else:
        rows = rows.withColumns({"lo": F.lit(spec.start), "_ot": F.lit(None).cast("long"), "_ov": F.lit(None).cast("double"), "_nt": F.lit(None).cast("long"), "_nv": F.lit(None).cast("double")})
    up = Window.partitionBy("series_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("series_key").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({"_pt": F.coalesce(F.last("_lt", True).over(up), "_ot"), "_pv": F.coalesce(F.last("_lv", True).over(up), "_ov")})
    if "twa" in bk.names:
        out = out.withColumns({"_qt": F.coalesce(F.last("_ft", True).over(down), "_nt"), "_qv": F.coalesce(F.last("_fv", True).over(down), "_nv")})
    none = F.col("_lt").isNull()
    for c, n in zip(value_columns(len(bk.names)), bk.names):
        if n == "last":
            out = out.withColumn(c, F.when(none, F.col("_pv")).otherwise(F.col(c)))
        elif n == "twa":
            p, q = (F.col("_pt"), F.col("_pv")), (F.col("_qt"), F.col("_qv"))
            ta, tb = F.greatest(F.col("_b"), F.col("lo")), F.least(F.col("_b") + bk.width, F.lit(spec.end))
            between = F.when(p[0].isNotNull() & q[0].isNotNull(), (line_at(ta, *p, *q) + line_at(tb, *p, *q)) / 2)
            out = out.withColumn(c, F.when(none, between).otherwise(F.col(c)))
    return out


def limited(rows: DataFrame, by: list[str], count: int | None, reverse: bool) -> DataFrame:
    """The first `count` rows of each key in the direction of the query."""
    if count is None:
        return rows
    w = Window.partitionBy(*by).orderBy(F.desc("ts") if reverse else F.asc("ts"))
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= count).drop("_rank")


def range_rows(ts: TimeSeries, selected: DataFrame, spec: RangeSpec, single: bool = False) -> DataFrame:
    """series_key, ts, value, value_2 … of the selected series, in no order, without the row limit.

    With `single` the samples of `ts` are those of the selected series already.
    """
    kept = kept_rows(ts, selected, spec, single)
    if spec.buckets:
        return bucketed(kept, spec)
    return kept.where((F.col("ts") >= F.col("lo")) & (F.col("ts") <= spec.end)).select("series_key", "ts", "value")


def range_query(ts: TimeSeries, key: str, spec: RangeSpec) -> DataFrame:
    """One series: ts, value …, ordered."""
    one = ts.series.where(F.col("series_key") == key)
    if spec.latest:
        rows = range_rows(ts, one, spec).drop("series_key")
    else:
        row = catalog(one).select("retention_ms").first()
        base = replace(ts.of(key), scan=lambda _, lo, hi: ts.between(lo, hi, key))
        if row is None:
            base = base.with_samples(base.samples.limit(0))
        elif not row.retention_ms:
            spec = replace(spec, retention=False)
        rows = range_rows(base, one, spec, single=True).drop("series_key")
    rows = rows.orderBy(F.desc("ts") if spec.reverse else F.asc("ts"))
    return rows.limit(spec.count) if spec.count else rows
