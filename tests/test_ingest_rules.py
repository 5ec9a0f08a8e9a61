"""Ingest fold, increments, deletion, downsampling rules, policies."""

import math

import pytest

from chronoloom.functions.policies import parse_policies
from chronoloom.model import CATALOG, EngineConfig, TimeSeries, series_row
from chronoloom.operators import ingest, rules
from chronoloom.operators.multi import last_points
from chronoloom.operators.ranges import range_query
from chronoloom.plans.specs import Buckets, RangeSpec

LOG = "series_key string, ts long, value double, seq long, on_duplicate string"


def catalog(spark, **series):
    return spark.createDataFrame([series_row(k, **o) for k, o in series.items()], CATALOG)


def log(spark, rows):
    return spark.createDataFrame([(r[0], r[1], None if r[2] is None else float(r[2]), i, r[3] if len(r) > 3 else None) for i, r in enumerate(rows)], LOG)


def folded(df):
    return {(r.series_key, r.ts): r.value for r in df.collect()}


@pytest.mark.parametrize("policy,want", [("last", 7), ("first", 5), ("min", 5), ("max", 9), ("sum", 21), ("block", 5)])
def test_policies(spark, policy, want):
    rows = log(spark, [("s", 10, 5), ("s", 20, 1), ("s", 10, 9), ("s", 10, 7)])
    assert folded(ingest.fold(rows, catalog(spark, s={"duplicate_policy": policy}))) == {("s", 10): want, ("s", 20): 1}
    if policy != "block":
        assert folded(ingest.fold_plain(rows, policy)) == {("s", 10): want, ("s", 20): 1}


def test_precedence_and_nan(spark):
    nan = math.nan
    cat = catalog(spark, a={"duplicate_policy": "sum"}, b={})
    got = folded(ingest.fold(log(spark, [("a", 1, 2), ("a", 1, 3), ("a", 1, 9, "LAST"), ("b", 1, 2), ("b", 1, 3), ("a", 2, nan), ("a", 2, 4), ("b", 3, nan, "first"), ("b", 3, 8, "first"), ("b", 4, 8), ("b", 4, nan, "last")]), cat, config=EngineConfig("max")))
    assert math.isnan(got.pop(("a", 2)))
    assert got == {("a", 1): 9, ("b", 1): 3, ("b", 3): 8, ("b", 4): 8}


def test_ignore(spark):
    rows = [(1000, 1), (1001, 2), (1006, 3), (1007, 8), (1008, 10), (1009, 15.0001)]
    for policy, want in (("last", [1000, 1006, 1008, 1009]), ("max", [r[0] for r in rows])):
        cat = catalog(spark, s={"duplicate_policy": policy, "ignore": (5, 5.0)})
        assert sorted(t for _, t in folded(ingest.fold(log(spark, [("s", *r) for r in rows]), cat))) == want


def test_retention_and_unreadable(spark):
    cat = catalog(spark, s={"retention_ms": 10})
    out = ingest.outcomes(log(spark, [("s", 100, 1), ("s", 89, 1), ("s", 90, 1), ("s", None, 1), ("s", 95, None), (None, 5, 1), ("s", -3, 1), ("s", 96, 1, "odd"), ("t", 5, 1)]), cat)
    got = sorted((r.seq, r.status) for r in out.collect())
    assert [s for _, s in got] == ["accepted", "rejected", "accepted", *["unreadable"] * 5, "accepted"]
    stored = spark.createDataFrame([("s", 200, 4.0)], "series_key string, ts long, value double")
    assert folded(ingest.fold(log(spark, [("s", 150, 1), ("s", 195, 2), ("s", 200, 9, "sum")]), cat, stored)) == {("s", 195): 2, ("s", 200): 13}


def test_out_of_order(spark):
    cat = catalog(spark, s={})
    a = log(spark, [("s", t, t) for t in [*range(0, 100, 10), *range(5, 100, 10)]])
    assert folded(ingest.fold(a, cat)) == {("s", t): t for t in range(0, 100, 5)}


def test_blocks_of_arrivals_change_nothing(spark):
    rows = log(spark, [("s", (i * 37) % 101, i) for i in range(150)])
    cat = catalog(spark, s={"retention_ms": 40})
    one = {r.seq: r.status for r in ingest.outcomes(rows, cat).collect()}
    assert one == {r.seq: r.status for r in ingest.outcomes(rows, cat, block=7).collect()}
    top, want = None, {}
    for i in range(150):
        t = (i * 37) % 101
        want[i] = "rejected" if top is not None and top - t > 40 else "accepted"
        top = t if top is None else max(top, t)
    assert one == want


def test_increments(spark):
    rows = spark.createDataFrame([("s", 1, 5.0, 0), ("s", 2, -2.0, 1), ("s", 1, 9.0, 2), ("s", 2, 1.0, 3), ("t", 7, 1.0, 4)], "series_key string, ts long, delta double, seq long")
    assert folded(ingest.increments(rows, block=2)) == {("s", 1): 5, ("s", 2): 4, ("t", 7): 1}
    stored = spark.createDataFrame([("s", 1, 100.0)], "series_key string, ts long, value double")
    assert folded(ingest.increments(rows, stored))[("s", 2)] == 104


def test_delete(spark):
    s = spark.createDataFrame([("s", t, 1.0) for t in range(10)], "series_key string, ts long, value double")
    assert ingest.delete_range(s, "s", 3, 5).count() == 7 and ingest.deleted_count(s, "s", 3, 5) == 3


def rule_frame(spark, *rows):
    return spark.createDataFrame(list(rows), rules.RULES)


def test_rule_and_latest(spark, make):
    ts = make({"src": ({}, [(1, 1), (2, 3), (11, 7), (13, 1)]), "dst": ({}, [])})
    ts = rules.create_rule(ts, "src", "dst", "SUM", 10)
    closed = rules.closed_buckets(ts.samples, ts.rules)
    assert [(r.ts, r.value) for r in closed.collect()] == [(0, 4.0)]
    full = ts.with_samples(ts.samples.unionByName(closed.withColumnRenamed("dest_key", "series_key")))
    assert [tuple(r) for r in range_query(full, "dst", RangeSpec(0, 10, latest=True)).collect()] == [(0, 4), (10, 8)]
    assert [tuple(r) for r in range_query(full, "dst", RangeSpec(0, 10)).collect()] == [(0, 4)]
    assert [tuple(r) for r in range_query(full, "dst", RangeSpec(0, 9, latest=True)).collect()] == [(0, 4)]
    assert range_query(full, "dst", RangeSpec(11, 30, latest=True)).collect() == []
    assert last_points(full, full.series.where("series_key = 'dst'"), latest=True).first().ts == 10
    for bad in (("src", "src"), ("dst", "src"), ("src", "dst"), ("nope", "dst")):
        with pytest.raises(ValueError):
            rules.create_rule(ts, *bad, "sum", 10)
    with pytest.raises(ValueError):
        rules.delete_rule(ts, "dst", "src")
    assert rules.delete_rule(ts, "src", "dst").rules.isEmpty()


@pytest.mark.parametrize("agg", ["sum", "avg", "min", "max", "count", "first", "last", "range", "std.p", "var.s", "twa", "countall"])
def test_rule_equals_range(spark, make, agg):
    ts = make({"s": ({}, [(t, (t * 7) % 23) for t in range(3, 60, 3)])})
    got = {r.ts: r.value for r in rules.closed_buckets(ts.samples, rule_frame(spark, ("s", "d", agg, 10, 2))).collect()}
    want = {r.ts: r.value for r in range_query(ts, "s", RangeSpec(buckets=Buckets((agg,), 10, 2))).collect()}
    del want[max(want)]
    assert got == pytest.approx(want)


def test_queries_of_open_buckets_leave_no_rule_out(spark):
    from chronoloom.plans.series_queries import QUERIES, _plain
    from chronoloom.sources import project

    folder = "/root/testdata/sf0.01"
    ts = project.monitoring(spark, folder)
    want = sorted(map(repr, _plain(rules.open_buckets(ts, ts.series)).collect()))
    got = [QUERIES[q](spark, folder).collect() for q in ("rule_latest", "rule_latest_twa")]
    assert sorted(map(repr, got[0] + got[1])) == want and all(got)


def test_refresh_after_late_rows_and_deletes(spark, make):
    first = make({"s": ({}, [(t, t) for t in range(0, 50, 5)])}).samples
    r = rule_frame(spark, ("s", "d", "sum", 10, 0), ("s", "e", "max", 20, 0))
    dest = rules.closed_buckets(first, r).withColumnRenamed("dest_key", "series_key")
    late = spark.createDataFrame([("s", 12, 100.0)], "series_key string, ts long, value double")
    after = first.unionByName(late)
    got = folded(rules.refresh(dest, after, r, late))
    assert got == folded(rules.closed_buckets(after, r).withColumnRenamed("dest_key", "series_key"))
    gone = ingest.delete_range(first, "s", 0, 9)
    removed = first.join(gone, ["series_key", "ts"], "left_anti")
    assert folded(rules.refresh(dest, gone, r, removed)) == folded(rules.closed_buckets(gone, r).withColumnRenamed("dest_key", "series_key"))


def test_policy_strings():
    p = parse_policies("max:1m:1h:1m;min:10s:10d:0m;last:5M:10m;avg:2h:10d:1d;avg:3d:100d")
    assert [x.bucket_ms for x in p] == [1, 10000, 300000, 7200000, 259200000]
    assert [x.align_ms for x in p] == [1, 0, 0, 86400000, 0]
    assert p[3].dest_key("k") == "k_AVG_7200000_86400000" and p[0].labels({"a": "b"}) == {"a": "b", "aggregation": "max", "time_bucket": "1"}
    for bad in ("max:1m", "max:x:1h", "nope:1m:1h", "max:0m:1h"):
        with pytest.raises(ValueError):
            parse_policies(bad)


def test_store(spark, make, tmp_path):
    from chronoloom.sources import store

    ts = make({"s": ({"a": "b"}, [(t * 86_400_000, t) for t in range(100)])})
    store.save(TimeSeries(ts.samples, ts.series), str(tmp_path / "x"))
    back = store.load(spark, str(tmp_path / "x"))
    assert folded(back.samples) == folded(ts.samples) and back.series.first().labels == {"a": "b"}
    got = store.scan(spark, str(tmp_path / "x"), 40 * 86_400_000, 50 * 86_400_000)
    assert got.count() == 11 and "PartitionFilters: [isnotnull(block" in got._jdf.queryExecution().toString()


def test_csv(spark, tmp_path):
    from chronoloom.sources import store

    (tmp_path / "t.csv").write_text("date,temp,err,city\n1900-01-01,1.5,0.1,Oslo\n1900-02-01,,0.2,Oslo\nbad,3,0.1,Oslo\n2000-01-01,2,0.5,Rome\n")
    ts = store.read_csv(spark, str(tmp_path / "t.csv"), "date", {"temp": "temp", "err": "err"}, {"city": "city"}, "date date, temp double, err double, city string")
    assert ts.series.count() == 4 and ts.samples.count() == 5


def test_repeats_without_thresholds(spark):
    """Repeats of the last sample under `last`, and only those; other policies and older repeats are no matter."""
    cat = catalog(spark, s={"duplicate_policy": "last"}, t={"duplicate_policy": "max"})
    rows = [("s", 5, 1), ("s", 5, 1), ("s", 5, 2), ("s", 5, 1), ("s", 9, 1), ("s", 5, 1), ("s", 9, 3, "sum"), ("s", 9, 4), ("s", 9, math.nan), ("t", 5, 1), ("t", 5, 1), ("t", 5, 1, "last")]
    want = ["accepted", "ignored", "accepted", "accepted", "accepted", "accepted", "accepted", "ignored", "accepted", "accepted", "accepted", "ignored"]
    assert [r.status for r in ingest.outcomes(log(spark, rows), cat).orderBy("seq").collect()] == want
    stored = spark.createDataFrame([("s", 5, 1.0)], "series_key string, ts long, value double")
    assert [r.status for r in ingest.outcomes(log(spark, rows[:1]), cat, stored).collect()] == ["ignored"]


def test_what_the_catalog_has_reached(spark):
    cat = catalog(spark, s={"duplicate_policy": "last", "retention_ms": 10}).selectExpr("*", "100L as last_timestamp")
    rows = log(spark, [("s", 80, 1), ("s", 95, 1), ("s", 100, 7)])
    assert [r.status for r in ingest.outcomes(rows, cat).orderBy("seq").collect()] == ["rejected", "accepted", "accepted"]
