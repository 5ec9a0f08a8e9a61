"""Queries over many series: ranges with labels, group and reduce, pivot by time, last points, tail reads, info."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.aggregates import ZERO, aggregate
from chronoloom.model import TimeSeries, catalog
from chronoloom.operators.ranges import limited, range_rows, value_columns
from chronoloom.operators.select import select_series, selected_labels
from chronoloom.plans.specs import Buckets, MultiRangeSpec, RangeSpec
from chronoloom.session import sized_join


def multi_range(ts: TimeSeries, spec: MultiRangeSpec) -> DataFrame:
    """All series that the filter selects, or their groups.

    Without grouping: series_key, labels if asked for, ts, value …; a selected series without rows comes out with a
    null ts unless empty series are excluded. With grouping see `group_reduce`.
    """
    selected = select_series(ts.series, spec.filters)
    if spec.group_by is not None:
        return group_reduce(ts, selected, spec)
    rows = limited(range_rows(ts, selected, spec.range), ["series_key"], spec.range.count, spec.range.reverse)
    keys = [F.col("series_key")]
    if spec.with_labels:
        keys.append(F.col("labels"))
    elif spec.selected_labels:
        keys.append(selected_labels(list(spec.selected_labels)).alias("labels"))
    if len(keys) == 1 and spec.exclude_empty:
        return rows
    listed = selected.select(*keys)
    if spec.exclude_empty:
        return sized_join(rows, listed, ["series_key"])
    # the small side can't be broadcast in a left join with the samples: series without rows are added instead
    none = listed.join(rows.select("series_key").distinct(), "series_key", "left_anti")
    return sized_join(rows, listed, ["series_key"]).select(*listed.columns, *rows.columns[1:]).unionByName(none, allowMissingColumns=True)


def group_reduce(ts: TimeSeries, selected: DataFrame, spec: MultiRangeSpec) -> DataFrame:
    """Samples of equal time tags of all series of a group, reduced: group_name, ts, value.

    Series are ranged and aggregated first; series without the label are left out. NaN is left out of a reduction
    unless all inputs are NaN: then the counts give 0 or their count and the others NaN.
    """
    label, r = spec.group_by, spec.reduce
    member = selected.select("series_key", F.col("labels").getItem(label).alias("_value")).where(F.col("_value").isNotNull())
    one = RangeSpec(**{**spec.range.__dict__, "count": None, "reverse": False})
    rows = sized_join(range_rows(ts, selected.where(F.col("labels").getItem(label).isNotNull()), one), member, ["series_key"])
    value = F.coalesce(aggregate(r, F.col("value"), F.col("ts")), F.lit(0.0 if r in ZERO and r != "sum" else float("nan")))
    out = rows.groupBy("_value", "ts").agg(value.alias("value"))
    out = out.select(F.concat(F.lit(f"{label}="), F.col("_value")).alias("group_name"), "ts", "value")
    return limited(out, ["group_name"], spec.range.count, spec.range.reverse)


def group_labels(ts: TimeSeries, spec: MultiRangeSpec) -> DataFrame:
    """Identity of the groups: group_name and labels (the label, __reducer__, __source__: keys in order, joined by commas)."""
    label = spec.group_by
    member = select_series(ts.series, spec.filters).select("series_key", F.col("labels").getItem(label).alias("_value")).where(F.col("_value").isNotNull())
    named = member.groupBy("_value").agg(F.array_join(F.sort_array(F.collect_set("series_key")), ",").alias("_keys"))
    labels = F.create_map(F.lit(label), F.col("_value"), F.lit("__reducer__"), F.lit(spec.reduce), F.lit("__source__"), F.col("_keys"))
    return named.select(F.concat(F.lit(f"{label}="), F.col("_value")).alias("group_name"), labels.alias("labels"))


def pivot_range(ts: TimeSeries, keys: Sequence[str], spec: RangeSpec, aggregators: Sequence[str | Sequence[str]] | None = None) -> DataFrame:
    """One row per time tag: ts and a column c0, c1 … for each key in order (and each of its aggregators), NaN where a key has none.

    `aggregators` has one entry per key, all sharing the buckets of `spec`; a key may occur more than once.
    """
    if not keys:
        raise ValueError("at least one key is needed")
    if spec.buckets and aggregators is None:
        aggregators = [spec.buckets.names] if len(keys) == 1 else None
    if (spec.buckets is None) != (aggregators is None) or (aggregators is not None and len(aggregators) != len(keys)):
        raise ValueError("the number of aggregators must equal the number of keys")
    present = {r.series_key for r in ts.series.where(F.col("series_key").isin(*set(keys))).select("series_key").collect()}
    if missing := [k for k in keys if k not in present]:
        raise ValueError(f"there is no series {missing[0]!r}")
    b = spec.buckets
    wanted: list[tuple[str, tuple[str, ...]]] = [(k, tuple(Buckets(a if not isinstance(a, str) else a.split(","), b.width).names) if b else ()) for k, a in zip(keys, aggregators or [()] * len(keys))]
    parts = None
    for names in dict.fromkeys(n for _, n in wanted):
        own = {k for k, n in wanted if n == names}
        one = RangeSpec(**{**spec.__dict__, "count": None, "reverse": False, "buckets": Buckets(names, b.width, b.align, b.label, b.empty) if b else None})
        rows = range_rows(ts, ts.series.where(F.col("series_key").isin(*own)), one)
        values = F.array(*[F.col(c) for c in value_columns(max(1, len(names)))])
        rows = rows.select("ts", "series_key", F.lit(",".join(names)).alias("_names"), values.alias("_values"))
        parts = rows if parts is None else parts.unionByName(rows)
    cols = []
    for k, names in wanted:
        mine = (F.col("series_key") == k) & (F.col("_names") == ",".join(names))
        for i in range(max(1, len(names))):
            cols.append(F.coalesce(F.max(F.when(mine, F.col("_values")[i])), F.lit(float("nan"))).alias(f"c{len(cols)}"))
    out = parts.groupBy("ts").agg(*cols).orderBy(F.desc("ts") if spec.reverse else F.asc("ts"))
    return out.limit(spec.count) if spec.count else out


def last_points(ts: TimeSeries, selected: DataFrame, latest: bool = False) -> DataFrame:
    """series_key, ts and value of the newest sample; retention doesn't matter. Series without samples give no row."""
    rows = ts.samples.select("series_key", "ts", "value")
    if latest:
        from chronoloom.operators.rules import open_buckets

        rows = rows.unionByName(open_buckets(ts, selected))
    rows = sized_join(rows, selected.select("series_key").distinct(), ["series_key"], "left_semi")
    return rows.groupBy("series_key").agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value"))


def get(ts: TimeSeries, key: str, latest: bool = False) -> DataFrame:
    """Newest sample of one series."""
    one = ts if latest else ts.of(key)
    return last_points(one, one.series.where(F.col("series_key") == key), latest).select("ts", "value")


def multi_get(ts: TimeSeries, filters: Sequence[str], with_labels: bool = False, labels: Sequence[str] = (), latest: bool = False) -> DataFrame:
    """Newest sample of every selected series; those without samples are listed with null."""
    selected = select_series(ts.series, filters)
    keys = [F.col("series_key"), *([F.col("labels")] if with_labels else [selected_labels(list(labels)).alias("labels")] if labels else [])]
    return selected.select(*keys).join(last_points(ts, selected, latest), "series_key", "left")


def cursor_of(ts: TimeSeries, key: str, cursor: int | str) -> int:
    """The time tag that a cursor stands for: itself, `-` (0), `+` (the last one) or `$` (one behind the last, as far as there is one)."""
    if cursor in ("+", "$"):
        last = ts.of(key).samples.agg(F.max("ts")).first()[0]
        return 0 if last is None else min(last + (cursor == "$"), (1 << 63) - 1)
    return 0 if cursor == "-" else int(cursor)


def tail_read(ts: TimeSeries, key: str, cursor: int | str = "-", most: int | None = None) -> DataFrame:
    """Samples from `cursor` on, ascending: a time tag, `-` (all), `+` (the last one) or `$` (after the last one)."""
    rows = ts.of(key).samples.select("ts", "value")
    rows = rows.where(F.col("ts") >= cursor_of(ts, key, cursor)).orderBy("ts")
    return rows.limit(most) if most else rows


def info(ts: TimeSeries, selected: DataFrame | None = None) -> DataFrame:
    """Per series: total_samples and first_timestamp within retention, last_timestamp, options, labels, source_key, rules."""
    cat = catalog(ts.series if selected is None else selected)
    rows = sized_join(ts.samples.select("series_key", "ts"), cat.select("series_key").distinct(), ["series_key"], "left_semi")
    last = rows.groupBy("series_key").agg(F.max("ts").alias("_last"))
    bounds = cat.select("series_key", "retention_ms").join(last, "series_key")
    bounds = bounds.select("series_key", F.when((F.col("retention_ms") > 0) & (F.col("_last") > F.col("retention_ms")), F.col("_last") - F.col("retention_ms")).otherwise(F.lit(0)).alias("_from"))
    stats = sized_join(rows, bounds, ["series_key"], once=True).groupBy("series_key").agg(
        F.count_if(F.col("ts") >= F.col("_from")).alias("total_samples"), F.min(F.when(F.col("ts") >= F.col("_from"), F.col("ts"))).alias("first_timestamp"), F.max("ts").alias("last_timestamp")
    )
    out = cat.join(stats, "series_key", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("total_samples", "first_timestamp", "last_timestamp")})
    if ts.rules is not None:
        rules = ts.rules.groupBy(F.col("source_key").alias("series_key")).agg(F.sort_array(F.collect_list(F.struct("dest_key", "bucket_ms", "agg", "align_ms"))).alias("rules"))
        out = out.join(rules, "series_key", "left")
    return out


def times_where(ts: TimeSeries, key: str, least: float, filters: Sequence[str]) -> DataFrame:
    """Samples of the selected series at the times at which `key` exceeds `least` (a semi-join on ts)."""
    times = ts.samples.where((F.col("series_key") == key) & (F.col("value") > least) & ~F.isnan("value")).select("ts").distinct()
    rows = sized_join(ts.samples, select_series(ts.series, filters).select("series_key"), ["series_key"], "left_semi")
    return sized_join(rows, times, ["ts"], "left_semi", once=True).select("series_key", "ts", "value")


def newest_rows(ts: TimeSeries, filters: Sequence[str], n: int) -> DataFrame:
    """The newest `n` rows of each selected series."""
    w = Window.partitionBy("series_key").orderBy(F.desc("ts"))
    rows = sized_join(ts.samples, select_series(ts.series, filters).select("series_key"), ["series_key"], "left_semi")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).select("series_key", "ts", "value")
