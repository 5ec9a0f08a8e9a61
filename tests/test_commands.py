"""Commands that write, and rules that follow them."""

import pytest

from chronoloom.model import CATALOG, TimeSeries
from chronoloom.operators import rules
from chronoloom.plans.grammar import Engine


@pytest.fixture
def engine(spark):
    return Engine(TimeSeries(spark.createDataFrame([], "series_key string, ts long, value double"), spark.createDataFrame([], CATALOG)))


def got(engine, command):
    return [tuple(r) for r in engine.run(command).collect()]


def test_add_and_policies(engine):
    engine.run("TS.CREATE s RETENTION 100 DUPLICATE_POLICY sum LABELS a b")
    assert got(engine, "ADD s 10 1.5") == [(10,)]
    engine.run("ADD s 10 2")
    engine.run("ADD s 10 9 ON_DUPLICATE last")
    assert got(engine, "MADD s 20 1 nope 5 1 s x 1 s 30 4") == [("s", 20, None), ("nope", 5, "there is no such series"), ("s", None, "couldn't parse time tag 'x'"), ("s", 30, None)]
    assert got(engine, "RANGE s - +") == [(10, 9.0), (20, 1.0), (30, 4.0)]
    engine.run("ADD s 200 1")
    with pytest.raises(ValueError):
        engine.run("ADD s 50 1")
    engine.run("ADD fresh 5 1 LABELS c d")
    with pytest.raises(ValueError):
        engine.run("ADD fresh 5 2")
    assert got(engine, "QUERYINDEX c=d") == [("fresh",)]
    for bad in ("ADD s -5 1", "ADD s 5 inf", "ADD s 5 x", "ADD s", "CREATE s", "CREATE q LABELS a", "ALTER q RETENTION 5", "DEL q 1 2", "MADD s 1"):
        with pytest.raises(ValueError):
            engine.run(bad)


def test_increments_and_delete(engine):
    engine.run("INCRBY c 5 TIMESTAMP 10")
    engine.run("DECRBY c 2 TIMESTAMP 10")
    engine.run("INCRBY c 4 TIMESTAMP 20")
    assert got(engine, "RANGE c - +") == [(10, 3.0), (20, 7.0)]
    with pytest.raises(ValueError):
        engine.run("INCRBY c 1 TIMESTAMP 5")
    assert got(engine, "DEL c 0 15") == [(1,)]
    assert got(engine, "RANGE c - +") == [(20, 7.0)]


def test_rule_follows_late_rows(engine):
    engine.run("CREATE src DUPLICATE_POLICY last")
    engine.run("CREATE dst")
    engine.run("CREATERULE src dst AGGREGATION sum 10")
    engine.run("MADD src 3 3 src 5 5 src 7 7 src 5 2 src 10 10")
    assert got(engine, "RANGE dst - +") == [(0, 12.0)]
    engine.run("MADD src 11 11 src 15 15 src 14 14 src 20 20 src 23 23 src 15 22")
    assert got(engine, "RANGE dst - +") == [(0, 12.0), (10, 57.0)]
    assert got(engine, "RANGE dst - + LATEST") == [(0, 12.0), (10, 57.0), (20, 43.0)]
    engine.run("DEL src 0 9")
    assert got(engine, "RANGE dst - +") == [(10, 57.0)]
    engine.run("DELETERULE src dst")
    engine.run("ADD src 99 1")
    assert got(engine, "RANGE dst - +") == [(10, 57.0)]


def test_rule_is_not_retroactive(engine):
    for k in ("src", "dst"):
        engine.run(f"CREATE {k}")
    engine.run("MADD src 1 1 src 2 2 src 3 3 src 11 11")
    engine.run("CREATERULE src dst AGGREGATION sum 10")
    assert got(engine, "RANGE dst - + LATEST") == []
    engine.run("MADD src 21 21 src 31 31")
    assert got(engine, "RANGE dst - +") == [(20, 21.0)]


def test_default_policies(engine):
    engine.run("CREATE m LABELS host h")
    ts = rules.apply_policies(engine.ts, "m", "max:10s:1h;avg:1M:0m:5s")
    keys = {r.series_key: r.labels for r in ts.series.collect()}
    assert keys["m_MAX_10000"] == {"host": "h", "aggregation": "max", "time_bucket": "10000"} and "m_AVG_60000_5000" in keys
    assert ts.rules.count() == 2


def test_delete_before_the_retention(engine):
    """A series with rules loses no samples of buckets that begin before its retention."""
    engine.run("CREATE old RETENTION 50")
    engine.run("CREATE sums")
    engine.run("CREATERULE old sums AGGREGATION sum 30")
    engine.run("MADD old 10 1 old 70 2 old 100 3 old 115 4")
    for bad in ("DEL old 0 80", "DEL old 66 80", "DEL old - +"):
        with pytest.raises(ValueError):
            engine.run(bad)
    assert got(engine, "DEL old 92 100") == [(1,)]
    engine.run("DELETERULE old sums")
    assert got(engine, "DEL old - +") == [(3,)]


def test_repeats_of_the_last_sample_are_ignored(engine):
    engine.run("CREATE z DUPLICATE_POLICY last")
    assert got(engine, "MADD z 5 1 z 5 1 z 5 2 z 7 1") == [("z", 5, None)] * 3 + [("z", 7, None)]
    assert got(engine, "RANGE z - +") == [(5, 2.0), (7, 1.0)]


def test_late_row_remakes_its_bucket_from_samples_before_the_rule(engine):
    engine.run("CREATE a DUPLICATE_POLICY last")
    engine.run("CREATE b")
    engine.run("MADD a 1 1 a 2 2 a 11 3")
    engine.run("CREATERULE a b AGGREGATION sum 10")
    assert got(engine, "RANGE b - +") == []
    engine.run("MADD a 12 4 a 21 5")
    assert got(engine, "RANGE b - +") == [(10, 4.0)]
    engine.run("ADD a 3 6")
    assert got(engine, "RANGE b - +") == [(0, 9.0), (10, 4.0)]
