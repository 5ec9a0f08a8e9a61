"""Downsampling rules: continuous aggregation of a source series into a destination series."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.aggregates import NAMES, aggregate, number, parse_names
from chronoloom.functions.policies import parse_policies
from chronoloom.model import TimeSeries, catalog, create
from chronoloom.operators.grid import clean_rules
from chronoloom.operators.neighbours import with_neighbours
from chronoloom.operators.readings import floor_to
from chronoloom.operators.twa import area_and_width
from chronoloom.session import checkpointed, sized_join

RULES = "source_key string, dest_key string, agg string, bucket_ms long, align_ms long"


def create_rule(ts: TimeSeries, source: str, dest: str, agg: str, bucket_ms: int, align_ms: int = 0, only_new: bool = False) -> TimeSeries:
    """Adds a rule; chains, second destinations and rules of a series onto itself are errors.

    With `only_new` the samples that the source has by now are left out (column since_ms of the rules).
    """
    names = parse_names(agg)
    if len(names) != 1:
        raise ValueError("a rule has exactly one aggregator")
    if bucket_ms <= 0 or align_ms < 0:
        raise ValueError("the bucket duration must be greater than zero and the alignment not negative")
    if source == dest:
        raise ValueError("the source and destination must differ")
    known = {r.series_key for r in ts.series.where(F.col("series_key").isin(source, dest)).select("series_key").collect()}
    for k in (source, dest):
        if k not in known:
            raise ValueError(f"there is no series {k!r}")
    spark = ts.series.sparkSession
    rules = ts.rules if ts.rules is not None else spark.createDataFrame([], RULES)
    if not rules.where(F.col("dest_key") == source).isEmpty():
        raise ValueError(f"{source!r} is a destination itself")
    if not rules.where((F.col("source_key") == dest) | (F.col("dest_key") == dest)).isEmpty():
        raise ValueError(f"{dest!r} has a rule already")
    since = ts.samples.where(F.col("series_key") == source).agg(F.max("ts")).first()[0] if only_new else None
    row = spark.createDataFrame([(source, dest, names[0], bucket_ms, align_ms, since)], RULES + ", since_ms long")
    series = catalog(ts.series).withColumn("source_key", F.when(F.col("series_key") == dest, F.lit(source)).otherwise(F.col("source_key")))
    return replace(ts, rules=rules.unionByName(row, allowMissingColumns=True), series=series)


def delete_rule(ts: TimeSeries, source: str, dest: str) -> TimeSeries:
    """Removes a rule; the samples of its destination stay."""
    hit = (F.col("source_key") == source) & (F.col("dest_key") == dest)
    if ts.rules is None or ts.rules.where(hit).isEmpty():
        raise ValueError("the rule does not exist")
    series = catalog(ts.series).withColumn("source_key", F.when(F.col("series_key") == dest, F.lit(None)).otherwise(F.col("source_key")))
    return replace(ts, rules=ts.rules.where(~hit), series=series)


def _by_name(agg: Column, value: Column, t: Column) -> Column:
    out = F.lit(None).cast("double")
    for n in NAMES:
        if n != "twa":
            out = F.when(agg == n, aggregate(n, value, t)).otherwise(out)
    return out


def rule_buckets(samples: DataFrame, rules: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All buckets of all rules: series_key, dest_key, bucket_ms, align_ms, ts (bucket start), value.

    `keep` filters the samples (with the columns of their rule and `_s`, the bucket start) before they are aggregated; without
    it a rule takes those behind its since_ms. Buckets in which the rule's aggregator accepted nothing are left out. Samples are unique by (series_key, ts).
    """
    rules = clean_rules(rules, "since_ms")
    new = F.col("since_ms").isNull() | (F.col("ts") > F.col("since_ms")) if "since_ms" in rules.columns else F.lit(True)
    key = ["series_key", "dest_key", "bucket_ms", "align_ms"]
    v, t, agg = F.col("value"), F.col("ts"), F.col("agg")
    b = floor_to(t, F.col("bucket_ms"), F.col("align_ms"))

    def placed(rows: DataFrame, of: DataFrame) -> DataFrame:
        out = sized_join(rows, of, ["series_key"], salt_of=["ts"]).withColumn("_b", b)
        return keep(out.withColumn("_s", F.greatest("_b", F.lit(0).cast("long")))) if keep else out.where(new)

    rows = placed(samples.select("series_key", "ts", "value"), rules.where(agg != "twa"))
    ok = F.when(agg == "countall", F.count(v)).when(agg == "countnan", F.count_if(F.isnan(v))).otherwise(F.count(number(v)))
    plain = rows.groupBy(*key, "agg", "_b").agg(_by_name(agg, v, t).alias("value"), ok.alias("_ok")).where("_ok > 0")
    out = plain.select(*key, "_b", "value")
    twa = rules.where(agg == "twa")
    if not twa.isEmpty():
        numbers = samples.select("series_key", "ts", "value").where(~F.isnan("value"))
        near = with_neighbours(sized_join(numbers, twa.select("series_key").distinct(), ["series_key"], "left_semi"), ["series_key"])
        rows = placed(near, twa)
        area, width = area_and_width(t, v, F.col("_b"), F.col("_b") + F.col("bucket_ms"), F.lit(-(1 << 62)), F.lit(1 << 62))
        sums = rows.withColumns({"_a": area, "_w": width}).groupBy(*key, "_b").agg(
            F.when(F.sum("_w") > 0, F.sum("_a") / F.sum("_w")).otherwise(F.max_by(v, t)).alias("value")
        )
        out = out.unionByName(sums)
    return out.select(*key, F.greatest(F.col("_b"), F.lit(0).cast("long")).alias("ts"), "value")


def _open_start(samples: DataFrame, rules: DataFrame) -> DataFrame:
    """Start of each rule's open bucket, the one of its source's newest sample."""
    last = samples.groupBy("series_key").agg(F.max("ts").alias("_last"))
    start = F.greatest(floor_to(F.col("_last"), F.col("bucket_ms"), F.col("align_ms")), F.lit(0).cast("long"))
    return last.join(clean_rules(rules).drop("agg").distinct(), "series_key").select("dest_key", "bucket_ms", "align_ms", start.alias("_open"))


def closed_buckets(samples: DataFrame, rules: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """What the rules have written: dest_key, ts, value of all buckets but the open one of each source."""
    key = ["dest_key", "bucket_ms", "align_ms"]
    return sized_join(rule_buckets(samples, rules, keep), _open_start(samples, rules), key, once=True).where(F.col("ts") < F.col("_open")).select("dest_key", "ts", "value")


def open_buckets(ts: TimeSeries, selected: DataFrame) -> DataFrame:
    """The open bucket of every selected destination, from its source's newest samples (series_key, ts, value).

    Nothing for series that are no destination, for buckets without an accepted sample, and where the destination
    has that bucket already.
    """
    none = ts.samples.select("series_key", "ts", "value").limit(0)
    if ts.rules is None:
        return none
    rules = ts.rules.join(selected.select(F.col("series_key").alias("dest_key")).distinct(), "dest_key", "left_semi")
    if rules.isEmpty():
        return none
    rules_of = clean_rules(rules)
    rows = sized_join(ts.samples.select("series_key", "ts", "value"), rules_of.select("series_key").distinct(), ["series_key"], "left_semi")
    key = ["dest_key", "bucket_ms", "align_ms"]
    opens = checkpointed(_open_start(rows, rules))
    since = F.col("since_ms").isNull() | (F.col("ts") > F.col("since_ms")) if "since_ms" in rules.columns else F.lit(True)
    # only samples of the open bucket are aggregated
    now = rule_buckets(rows, rules, lambda r: sized_join(r.where(since), opens, key, salt_of=["ts"]).where(F.col("_s") == F.col("_open")).drop("_open"))
    have = ts.samples.groupBy(F.col("series_key").alias("dest_key")).agg(F.max("ts").alias("_have"))
    now = now.join(have, "dest_key", "left").where(F.col("_have").isNull() | (F.col("_have") < F.col("ts")))
    return now.select(F.col("dest_key").alias("series_key"), "ts", "value")


def touched_buckets(changes: DataFrame, rules: DataFrame) -> DataFrame:
    """Buckets that changed samples (series_key, ts) fall into: dest_key, bucket_ms, align_ms, ts."""
    b = F.greatest(floor_to(F.col("ts"), F.col("bucket_ms"), F.col("align_ms")), F.lit(0).cast("long"))
    return sized_join(changes.select("series_key", "ts"), clean_rules(rules), ["series_key"], salt_of=["ts"]).select("dest_key", "bucket_ms", "align_ms", b.alias("ts")).distinct()


def refresh(dest: DataFrame, samples: DataFrame, rules: DataFrame, changes: DataFrame) -> DataFrame:
    """Destination samples (series_key, ts, value) after late rows or deletions.

    Only samples of the touched buckets and of buckets that the change closed are aggregated, out of `samples` (the state
    after the change), and replace what the destinations have; a closed bucket that has no sample left goes, the source's
    open bucket is not written. A change also moves the line of a time-weighted average in the buckets beside its own, so
    rules by `twa` of a changed source are made anew whole. A rule takes samples behind its since_ms; buckets with a
    change marked by a true column `late` of `changes` take all of theirs.
    """
    marked = changes.select("series_key", "ts", F.coalesce("late", F.lit(False)).alias("_late") if "late" in changes.columns else F.lit(False).alias("_late"))
    hit = clean_rules(rules, "since_ms").join(marked.select("series_key").distinct(), "series_key", "left_semi")
    key = ["dest_key", "bucket_ms", "align_ms"]
    start = F.greatest(floor_to(F.col("ts"), F.col("bucket_ms"), F.col("align_ms")), F.lit(0).cast("long"))
    touched = sized_join(marked, hit.select("series_key", *key).distinct(), ["series_key"], salt_of=["ts"]).groupBy(*key, start.alias("_s")).agg(F.max("_late").alias("_late"))
    touched = checkpointed(touched)
    have = checkpointed(dest.groupBy(F.col("series_key").alias("dest_key")).agg(F.max("ts").alias("_have")))
    since = F.col("since_ms").isNull() | (F.col("ts") > F.col("since_ms")) if "since_ms" in hit.columns else F.lit(True)

    def keep(rows: DataFrame) -> DataFrame:
        rows = sized_join(rows, touched, [*key, "_s"], "left", salt_of=["ts"])
        rows = sized_join(rows, have, ["dest_key"], "left", salt_of=["ts"])
        closed = F.col("_have").isNull() | (F.col("_s") > F.col("_have"))
        return rows.where(F.coalesce("_late", F.lit(False)) | (since & (F.col("_late").isNotNull() | closed))).drop("_late", "_have")

    again = hit.withColumnRenamed("series_key", "source_key")
    source = sized_join(samples.select("series_key", "ts", "value"), hit.select("series_key").distinct(), ["series_key"], "left_semi")
    new = closed_buckets(source, again.where(F.col("agg") != "twa"), keep)
    twa = again.where(F.col("agg") == "twa")
    if not twa.isEmpty():
        new = new.unionByName(closed_buckets(source, twa))
    new = checkpointed(new.withColumnRenamed("dest_key", "series_key"))
    gone = touched.select(F.col("dest_key").alias("series_key"), F.col("_s").alias("ts")).unionByName(new.select("series_key", "ts")).distinct()
    return dest.join(gone, ["series_key", "ts"], "left_anti").select("series_key", "ts", "value").unionByName(new)


def apply_policies(ts: TimeSeries, key: str, text: str) -> TimeSeries:
    """Creates the destinations and rules that a string of default policies asks for on a series."""
    row = catalog(ts.series).where(F.col("series_key") == key).first()
    if row is None:
        raise ValueError(f"there is no series {key!r}")
    for p in parse_policies(text):
        dest = p.dest_key(key)
        ts = create(ts, dest, labels=p.labels(row.labels or {}), retention_ms=p.retention_ms)
        ts = create_rule(ts, key, dest, p.agg, p.bucket_ms, p.align_ms, only_new=True)
    return ts
