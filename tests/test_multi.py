"""Selection, groups, pivots, last points, grammar."""

import math
import threading

import pytest
from pyspark.sql import functions as F

from chronoloom.model import alter, copy_series, create, rename_series
from chronoloom.operators import multi, select
from chronoloom.plans.grammar import Engine
from chronoloom.operators.ranges import range_query
from chronoloom.plans.specs import Buckets, MultiRangeSpec, RangeSpec
from chronoloom.sources import project


@pytest.fixture(scope="module")
def people(make):
    return make({
        "tester1": ({"name": "bob", "class": "middle", "generation": "x"}, [(1, 1)]),
        "tester2": ({"name": "rudy", "class": "junior", "generation": "x"}, []),
        "tester3": ({"name": "fabi", "class": "top", "generation": "x", "x": "2"}, [(5, 5)]),
        "tester4": ({"name": "anybody", "class": "top", "type": "noone", "x": "2", "z": "3"}, []),
    })


@pytest.mark.parametrize(
    "filters,want",
    [("generation=x", "1 2 3"), ("generation=x x=", "1 2"), ("generation=x class!=middle x=", "2"), ("z= x=2", "3"), ("class=(middle,junior) generation=x", "1 2"), ("class=()", ""),
     ("class=(middle,junior,top) name!=(bob,rudy,fabi)", "4"), ("x=2 z!=", "4"), ("class=top z!=3", "3")],
)
def test_matchers(people, filters, want):
    got = [r.series_key[-1] for r in select.query_index(people.series, filters.split()).orderBy("series_key").collect()]
    assert " ".join(got) == want


def test_matcher_errors(people):
    for bad in ("z= x!=2", "x!=(1,2)", "nonsense", "x=(1"):
        with pytest.raises(ValueError):
            select.query_index(people.series, bad.split())


def test_listings(people):
    e = Engine(people)
    assert [r.label for r in e.run("TS.QUERYLABELS LABELS FILTER generation=x").collect()] == ["class", "generation", "name", "x"]
    assert [r.value for r in e.run("QUERYLABELS VALUES class").collect()] == ["junior", "middle", "top"]


def test_mget_lists_unsampled_and_ignores_case_of_labels(people):
    got = Engine(people).run("MGET SELECTED_LABELS NAME team FILTER generation=x").collect()
    assert [(r.series_key, r.ts, r.labels) for r in got] == [
        ("tester1", 1, {"NAME": "bob", "team": None}), ("tester2", None, {"NAME": "rudy", "team": None}), ("tester3", 5, {"NAME": "fabi", "team": None}),
    ]


@pytest.fixture(scope="module")
def cpu(make):
    return make({"s1": ({"m": "cpu", "n": "user"}, [(1, 100), (2, 95)]), "s2": ({"m": "cpu", "n": "user"}, [(2, 55)]), "s3": ({"m": "cpu", "n": "system"}, [(2, 40)])})


@pytest.mark.parametrize(
    "r,want",
    [("max", [100, 95]), ("sum", [100, 150]), ("min", [100, 55]), ("avg", [100, 75]), ("count", [1, 2]), ("range", [0, 40]), ("var.p", [0, 400]), ("var.s", [0, 800]), ("std.p", [0, 20]), ("std.s", [0, 28.284271]),
     ("countnan", [0, 0]), ("countall", [1, 2])],
)
def test_group_reduce(cpu, r, want):
    rows = Engine(cpu).run(f"MRANGE - + FILTER m=cpu GROUPBY n REDUCE {r}").collect()
    got = [x.value for x in sorted((x for x in rows if x.group_name == "n=user"), key=lambda x: x.ts)]
    assert got == pytest.approx(want)
    assert len(Engine(cpu).run(f"MRANGE - + COUNT 1 FILTER m=cpu GROUPBY n REDUCE {r}").collect()) == 2


def test_group_identity(cpu):
    got = multi.group_labels(cpu, MultiRangeSpec(("m=cpu",), group_by="n", reduce="max")).orderBy("group_name").collect()
    assert got[1].labels == {"n": "user", "__reducer__": "max", "__source__": "s1,s2"}


def test_empty_then_reduce(make):
    ts = make({"k1": ({"l": "a"}, [(t, 1) for t in [*range(10), *range(20, 30)]], {"retention_ms": 100}), "k2": ({"l": "a"}, [(t, 2) for t in range(10)], {"retention_ms": 100})})
    spec = MultiRangeSpec(("l=a",), RangeSpec(0, 29, buckets=Buckets(("sum",), 10, empty=True)), group_by="l", reduce="sum")
    assert sorted((r.ts, r.value) for r in multi.multi_range(ts, spec).collect()) == [(0, 30), (10, 0), (20, 10)]


def test_nan_in_reduce(make):
    nan = math.nan
    ts = make({"a": ({"l": "x"}, [(1, nan), (2, nan)]), "b": ({"l": "x"}, [(1, 5), (2, nan)])})
    for r, want in (("sum", [5, nan]), ("max", [5, nan]), ("count", [1, 0]), ("countnan", [1, 2])):
        got = [x.value for x in Engine(ts).run(f"MRANGE - + FILTER l=x GROUPBY l REDUCE {r}").orderBy("ts").collect()]
        assert got == pytest.approx(want, nan_ok=True)


@pytest.fixture(scope="module")
def candles(make):
    base = [(0, 10), (3, 14), (6, 8), (9, 11)]
    late = [(10, 12), (13, 9), (17, 15)]
    return make({k: ({}, base + (late if k != "close" else [])) for k in ("open", "high", "low", "close", "vol")})


def test_pivot(candles):
    e = Engine(candles)
    raw = e.run("NRANGE 5 open high low close vol - +").collect()
    assert len(raw) == 7 and [math.isnan(r.c3) for r in raw] == [False] * 4 + [True] * 3
    got = [tuple(r) for r in e.run("NRANGE 5 open high low close vol - + AGGREGATION first max min last sum 10").collect()]
    assert got[0] == (0, 10, 14, 8, 11, 43)
    assert got[1][:4] == (10, 12, 15, 9) and math.isnan(got[1][4]) and got[1][5] == 36
    back = [r.ts for r in e.run("NREVRANGE 2 open open - + COUNT 3").collect()]
    assert back == [17, 13, 10]
    for bad in ("NRANGE 2 open high - + AGGREGATION sum 10", "NRANGE 2 open nope - +", "NRANGE 0 - +"):
        with pytest.raises(ValueError):
            e.run(bad)


def test_pivot_equals_merged_ranges(make):
    ts = make({"a": ({}, [(t, 100 + t) for t in range(5)]), "b": ({}, [(t, 200 + t) for t in range(2, 7)]), "c": ({}, [(t, 300 + t) for t in (0, 3, 6)])})
    got = {r.ts: (r.c0, r.c1, r.c2) for r in multi.pivot_range(ts, ["a", "b", "c"], RangeSpec()).collect()}
    for t in range(7):
        want = (100 + t if t < 5 else math.nan, 200 + t if t >= 2 else math.nan, 300 + t if t in (0, 3, 6) else math.nan)
        assert got[t] == pytest.approx(want, nan_ok=True)


def test_read_get_info(candles):
    e = Engine(candles)
    assert [r.ts for r in e.run("READ open 9 MAX_COUNT 2").collect()] == [9, 10]
    assert [r.ts for r in e.run("READ open +").collect()] == [17]
    assert e.run("READ open $").collect() == []
    assert tuple(e.run("GET open").first()) == (17, 15.0)
    i = e.run("INFO close").first()
    assert (i.total_samples, i.first_timestamp, i.last_timestamp) == (4, 0, 9)


@pytest.mark.parametrize(
    "bad",
    ["RANGE", "RANGE s - + COUNT x", "RANGE s - + COUNT 0", "RANGE s - + ALIGN 5", "RANGE s - + AGGREGATION nope 5", "RANGE s - + AGGREGATION sum 0", "RANGE s - + ALIGN start AGGREGATION sum 5", "RANGE s - + what",
     "MRANGE - +", "MRANGE - + FILTER a!=b", "MRANGE - + GROUPBY l REDUCE sum FILTER a=b", "MRANGE - + FILTER a=b GROUPBY l REDUCE last", "MRANGE - + AGGREGATION sum,min 5 FILTER a=b GROUPBY l REDUCE sum",
     "MRANGE - + WITHLABELS SELECTED_LABELS x FILTER a=b", "MRANGE - + FILTER a=b GROUPBY l REDUCE sum EXCLUDEEMPTY", "QUERYLABELS", "FLY s"],
)
def test_grammar_errors(candles, bad):
    with pytest.raises(ValueError):
        Engine(candles).run(bad)


def test_catalog_changes(people):
    ts = create(people, "new", labels={"a": "b"}, retention_ms=5)
    assert ts.series.where("series_key = 'new'").first().retention_ms == 5
    ts = alter(ts, "new", labels={"c": "d"})
    row = ts.series.where("series_key = 'new'").first()
    assert (row.labels, row.retention_ms) == ({"c": "d"}, 5)
    ts = copy_series(ts, "tester1", "twin")
    assert multi.get(ts, "twin").first().ts == 1
    ts = rename_series(ts, "tester3", "third")
    assert multi.get(ts, "third").first().ts == 5 and multi.get(ts, "tester3").collect() == []
    for bad in (lambda: create(people, "tester1"), lambda: create(people, "q", labels={"a": "(b"}), lambda: alter(people, "tester1", encoding="compressed"), lambda: create(people, "q", chunk_size=7)):
        with pytest.raises(ValueError):
            bad()


def test_read_block(people):
    e = Engine(people)
    assert [r.ts for r in e.run("READ tester3 - BLOCK 50 1").collect()] == [5]
    assert e.run("READ tester3 $ BLOCK 50 1").collect() == []
    assert [r.ts for r in e.run("READ tester3 0 MAX_COUNT 3 BLOCK 50 3").collect()] == [5]
    for bad in ("READ k 0 BLOCK 100", "READ k 0 BLOCK -1 1", "READ k 0 BLOCK 5 0", "READ k 0 MAX_COUNT 0", "READ k 0 MAX_COUNT 2 BLOCK 5 3", "READ k -7", "READ k 0 BLOCK 1 1 BLOCK 1 1"):
        with pytest.raises(ValueError):
            e.run(bad)


def test_read_block_wakes_up(people):
    e, got = Engine(people), []
    waiting = threading.Thread(target=lambda: got.extend(e.run("READ tester1 2 BLOCK 0 1").collect()))
    waiting.start()
    e.run("ADD tester1 9 4")
    waiting.join(60)
    assert [tuple(r) for r in got] == [(9, 4.0)]


def test_listing_without_a_shuffle_of_samples(spark, data):
    """Series without rows are listed, and the samples meet the small side by a broadcast."""
    ts = project.events(spark, data)
    out = multi.multi_range(ts, MultiRangeSpec(("measurement=events",), with_labels=True))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan.split("Union")[1].split("BroadcastHashJoin [series_key", 2)[0]
    assert out.where("ts is not null").count() == ts.samples.count()


def test_time_bounds_reach_the_scan(spark, data):
    ts = project.events(spark, data)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = range_query(ts, "events:click:7", RangeSpec(1704412800000, 1705708800000))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed and "EqualTo(event_type,click)" in pushed
    lo = 1704412800123
    assert {tuple(r) for r in ts.between(lo, lo + 86_400_000).collect()} == {tuple(r) for r in ts.samples.where(F.col("ts").between(lo, lo + 86_400_000)).collect()}


def test_too_many_time_tags():
    with pytest.raises(ValueError):
        RangeSpec(times=tuple(range(200)))


def test_copy_onto_a_key_that_exists(people):
    with pytest.raises(ValueError):
        copy_series(people, "tester1", "tester2")
