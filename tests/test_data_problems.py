"""The four general data problems against plain Python, with dirty rows, clashing names and empty tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom import session
from chronoloom.operators import grid, hotkeys, late, readings, rolling
from chronoloom.operators.readings import DAY_MS, HOUR_MS
from chronoloom.streaming.late import Replay

NAN = math.nan
SAMPLES = "series_key string, ts long, value double"
RULES = "source_key string, dest_key string, agg string, bucket_ms long, align_ms long"
# names that the operators use inside must do no harm as extra columns
CLASH = ("day", "n", "block", "last", "_salt", "period_start", "total")


def clashing(df):
    for c in CLASH:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x"))
    return df


def samples(spark, rows, clash=True):
    df = spark.createDataFrame(rows, SAMPLES)
    return clashing(df) if clash else df


# --- 1: grid
def test_grid(spark):
    rows = [("s", 3, 1.0), ("s", 3, 1.0), ("s", 14, 5.0), ("s", 15, 7.0), ("s", 44, 2.0), ("s", 300, 9.0), ("s", 20, NAN), ("s", 21, None), (None, 22, 1.0), ("s", None, 1.0), ("t", 5, 1.0)]
    rules = spark.createDataFrame([("s", "d", "SUM", 10, None), ("s", "d", "SUM", 10, None), ("s", "e", "twa", 10, 2), ("gone", "f", "sum", 10, 0), ("t", "g", "odd", 10, 0), ("s", None, "sum", 10, 0), ("s", "h", "sum", 0, 0)], RULES)
    got = grid.regular_grid(samples(spark, rows), clashing(rules).drop("total"), max_gap_ms=100)
    d = {r.period_start: (r.state, r.n, r.value, r.gap_ms) for r in got.where("dest_key = 'd'").collect()}
    assert len(d) == 31
    assert d[0] == ("read", 1, 1.0, None) and d[10] == ("read", 2, 12.0, None)
    assert d[20] == ("filled", 0, 7.0, 29) and d[30] == ("filled", 0, 7.0, 29)
    assert d[40][:3] == ("read", 1, 2.0) and d[50] == ("missing", 0, None, 256) and d[300][0] == "read"
    e = {r.period_start: r.value for r in got.where("dest_key = 'e' and state = 'read'").collect()}
    # from 12 to 22 the line runs over (3,1), (14,5), (15,7) and (44,2)
    f = lambda t: 1 + 4 * (t - 3) / 11 if t <= 14 else 5 + 2 * (t - 14) if t <= 15 else 7 - 5 * (t - 15) / 29
    area = (f(12) + 5) / 2 * 2 + (5 + 7) / 2 + (7 + f(22)) / 2 * 7
    assert e[12] == pytest.approx(area / 10)
    assert got.where("dest_key = 'g'").first().value is None and {r.dest_key for r in got.select("dest_key").distinct().collect()} == {"d", "e", "g"}
    found = grid.fillable_periods(samples(spark, rows), rules, 100)
    assert {tuple(r) for r in found.where("dest_key = 'd'").collect()} == {("d", 20), ("d", 30)}
    assert grid.regular_grid(samples(spark, [], False), rules).count() == 0 and grid.regular_grid(samples(spark, rows), spark.createDataFrame([], RULES)).count() == 0


def test_grid_beyond_the_broadcast_bound(spark, monkeypatch):
    import chronoloom.session as session

    rng = random.Random(1)
    rows = samples(spark, [(rng.choice("aab"), rng.randrange(500), 1.0) for _ in range(200)], False)
    rules = spark.createDataFrame([("a", "x", "sum", 7, 3), ("b", "y", "max", 11, None)], RULES)
    want = {tuple(r) for r in grid.regular_grid(rows, rules).collect()}
    monkeypatch.setattr(session, "is_bounded", lambda *a, **k: False)
    assert {tuple(r) for r in grid.regular_grid(rows, rules).collect()} == want


# --- 2: hot keys
def test_dense_totals(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(40)}", i, rng.choice([NAN, None, *[x / 8 for x in range(-20, 20)]])) for i in range(3000)] + [(None, 1, 1.0)]
    got = {r.key: (r.n, r.numbers, r.total, r.least, r.greatest) for r in hotkeys.dense_reduce(samples(spark, rows).repartition(5), "series_key", "value", slots=7).collect()}
    want = {}
    for k, _, v in rows:
        if k is not None:
            n, vs = want.setdefault(k, (0, []))
            want[k] = (n + 1, vs if v is None or math.isnan(v) else [*vs, v])
    assert got == {k: (n, len(vs), sum(vs) if vs else None, min(vs, default=None), max(vs, default=None)) for k, (n, vs) in want.items()}
    assert hotkeys.dense_reduce(samples(spark, [], False), "series_key", "value").count() == 0


def test_pairs(spark):
    rows = samples(spark, [("a", 1, 1.0)] * 30 + [("b", 1, NAN)] * 5 + [("free", 1, 1.0)] * 65)
    labels = spark.createDataFrame(
        [("a", "h", "x"), ("a", "h", "x"), ("a", "H", "x"), ("a", "h", "x "), ("b", "h", "x"), ("b", "g", ""), ("b", "g", None), ("b", None, "v"), (None, "h", "x"), ("none", "q", "r"), ("b", "j", 'y"\\')], "series_key string, label_key string, label_value string"
    )
    got = {(r.label_key, r.label_value): (r.n, r.numbers, r.total) for r in hotkeys.pair_totals(rows, clashing(labels)).collect()}
    assert got == {("h", "x"): (35, 30, 30.0), ("H", "x"): (30, 30, 30.0), ("h", "x "): (30, 30, 30.0), ("j", 'y"\\'): (5, 0, None)}
    assert {tuple(r) for r in hotkeys.heavy_pairs(rows, labels).collect()} == set(got)
    assert {tuple(r) for r in hotkeys.heavy_pairs(rows, labels, 3).collect()} == {("h", "x")}
    assert hotkeys.heavy_pairs(samples(spark, [], False), labels).count() == 0


# --- 3: rolling totals
def test_rolling(spark):
    rng = random.Random(3)
    days = sorted(rng.sample(range(-5, 80), 45))
    rows = [("s", d * DAY_MS + rng.randrange(DAY_MS), rng.randrange(-40, 80) / 8) for d in days for _ in range(2)]
    dirty = rows + rows[:20] + [("s", 500 * DAY_MS, NAN), ("s", 1, None), (None, 1, 1.0), ("t", 9 * DAY_MS, 2.0)]
    got = {r.day: r for r in rolling.rolling_totals(samples(spark, dirty)).where("series_key = 's'").collect()}
    assert sorted(got) == list(range(days[0], days[-1] + 1))
    for d, r in got.items():
        for p in (7, 30):
            vs = [v for _, t, v in set(rows) if d - p < t // DAY_MS <= d]
            act = {t // DAY_MS for _, t, _ in rows if d - p < t // DAY_MS <= d}
            assert (r[f"total_{p}"], r[f"n_{p}"], r[f"active_{p}"]) == (sum(vs), len(vs), len(act))
            assert r[f"per_day_{p}"] == sum(vs) / p and r[f"mean_{p}"] == (sum(vs) / len(vs) if vs else None)
    assert rolling.rolling_totals(samples(spark, dirty)).where("series_key = 't'").count() == 1
    want = {(d,) for d, r in got.items() if r.total_7 > r.total_30 / 2 and r.active_30 >= 12}
    text = rolling.busy_weeks(samples(spark, dirty), active=12).where("series_key = 's'").select(F.datediff(F.to_date("active_day"), F.lit("1970-01-01").cast("date")))
    assert {tuple(r) for r in text.collect()} == want
    assert rolling.busy_weeks(samples(spark, [], False)).count() == 0


# --- 4: late rows
LOG = "series_key string, ts long, value double, seq long"
CATALOG = "series_key string, last_timestamp long, retention_ms long"


def arrivals(rng, n=400):
    out, now = [], 10 * HOUR_MS
    for seq in range(0, 3 * n, 3):
        now += rng.randrange(HOUR_MS // 4)
        t = now - (rng.randrange(12 * HOUR_MS) if rng.random() < 0.3 else 0)
        out.append((rng.choice("aaab"), t, rng.choice([NAN, None, 1.0, 2.5]), seq))
    return out + out[5:25]


def plain(rows, catalog):
    last = {k: v for k, v, _ in catalog}
    ret = {k: r for k, _, r in catalog}
    out = {}
    for seq, k, t, v in sorted({(s, k, t, "nan" if v is not None and math.isnan(v) else v) for k, t, v, s in rows if v is not None}, key=lambda r: r[0]):
        top = last.get(k)
        kind = "on_time"
        if top is not None and ret.get(k) and ret[k] > 0 and top - t > ret[k]:
            kind = "beyond"
        elif top is not None and t // HOUR_MS < top // HOUR_MS:
            kind = "correction"
        last[k] = t if top is None else max(top, t)
        out[seq] = (k, t, v, kind)
    return out


@pytest.mark.parametrize("block", [1 << 20, 17])
def test_late(spark, block):
    rows = arrivals(random.Random(4))
    catalog = [("a", 11 * HOUR_MS, 4 * HOUR_MS), ("b", None, None), (None, 1, 1)]
    log = clashing(spark.createDataFrame(rows, LOG).withColumn("extra", F.lit(1)))
    series = clashing(spark.createDataFrame(catalog, CATALOG))
    want = plain(rows, [c for c in catalog if c[0]])
    got = late.replay(log, series, block).collect()
    assert {r.seq: r.kind for r in got} == {s: x[3] for s, x in want.items()} and len(got) == len(want)
    assert {r.seq for r in late.corrections(log, series, block).collect()} == {s for s, x in want.items() if x[3] == "correction"}
    hours = {(r.series_key, r.period_start): (r.n, r.total, r.n_first, r.corrections, r.beyond) for r in late.corrected_hours(log, series, block).collect()}
    for (k, h), (n, total, first, corr, beyond) in hours.items():
        own = [x for x in want.values() if x[0] == k and x[1] // HOUR_MS * HOUR_MS == h]
        kept = [x for x in own if x[3] != "beyond"]
        vs = [x[2] for x in kept if x[2] != "nan"]
        assert (n, total, first) == (len(kept), sum(vs) if vs else None, sum(x[3] == "on_time" for x in own))
        assert (corr, beyond) == (sum(x[3] == "correction" for x in own), sum(x[3] == "beyond" for x in own))
    assert late.corrections(spark.createDataFrame([], LOG), series).count() == 0
    assert late.replay(log, spark.createDataFrame([], CATALOG)).where("kind = 'beyond'").count() == 0


def test_extreme_times(spark):
    log = spark.createDataFrame([("a", (1 << 63) - 1, 1.0, 1), ("a", -(1 << 62), 1.0, 2), ("a", 5, 1.0, 3)], LOG)
    series = spark.createDataFrame([("a", None, 1000)], CATALOG)
    assert [r.kind for r in late.replay(log, series).orderBy("seq").collect()] == ["on_time", "beyond", "beyond"]


def test_replay_state_equals_batch():
    rows = [r for r in arrivals(random.Random(6)) if r[2] is not None]
    want = plain([("a", *r[1:]) for r in rows], [("a", None, 4 * HOUR_MS)])
    state, hours = Replay(None, 4 * HOUR_MS, spacing=8), {}
    for i, (_, t, v, seq) in enumerate(sorted(rows, key=lambda r: r[3])):
        kind, changed = state.add(seq, t, v)
        if kind != "copy":
            assert kind == want[seq][3]
        hours |= changed
        if i % 50 == 0:
            state.forget()
            state = Replay.load(state.dump())
    for h, (n, total) in hours.items():
        kept = [x for x in want.values() if x[1] // HOUR_MS * HOUR_MS == h and x[3] != "beyond"]
        assert (n, total) == (len(kept), sum(x[2] for x in kept if x[2] != "nan"))
    assert state.replayed < 60 * len(rows)


def test_hot_blocks_and_days_give_the_same(spark, data):
    """Blocks of periods and days of a series that are spread over several tasks."""
    rows, rules = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("samples", "rules"))
    grids = [{tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in grid.regular_grid(rows, rules, task_rows=n).collect()} for n in (2_000_000, 150)]
    assert grids[0] == grids[1] and len(grids[0]) > 1000
    days = [readings.readings(rows, n) for n in (2_000_000, 20)]
    assert {tuple(r) for r in days[0].collect()} == {tuple(r) for r in days[1].collect()}
    total = lambda df: {tuple(r) for r in df.groupBy("series_key", "day").agg(F.sum("value"), F.count("*")).collect()}
    assert total(days[0]) == total(days[1])


def test_one_shuffle_for_daily_totals(spark, data):
    plan = rolling.daily_totals(spark.read.parquet(f"{data}/samples.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_a_gap_of_many_days(spark):
    """Steps of the calendar: a gap of more days than one array holds."""
    daily = spark.createDataFrame([("a", 0, 1.0, 1), ("a", 3 * rolling.STEP, 2.0, 1), ("b", 5, 1.0, 2)], "series_key string, day long, total double, n long")
    got = rolling.with_calendar(daily)
    assert got.count() == 3 * rolling.STEP + 2 and got.agg(F.sum("active")).first()[0] == 3 and got.select("series_key", "day").distinct().count() == 3 * rolling.STEP + 2


@pytest.mark.parametrize("spacing,most", [(4, 7), (16, 50), (256, 400)])
def test_state_in_order_replaces_outputs(spacing, most):
    """Batches of arrivals against a plain pass: classes, hours, and that no more than the suffix is replayed."""
    r = random.Random(spacing)
    rows, clock = [], 0
    for seq in range(600):
        clock += r.randrange(0, HOUR_MS // 3)
        rows.append((seq // 2, clock - (r.randrange(6 * HOUR_MS) if r.random() < 0.2 else 0), NAN if r.random() < 0.1 else r.randrange(80) / 8))
    state, at, kinds = late.Ordered(5 * HOUR_MS, 4 * HOUR_MS, spacing), 0, []
    while at < len(rows):
        n = r.randint(1, most)
        seq, ts, v = (np.array(x) for x in zip(*rows[at : at + n]))
        kinds += [late.KINDS[k] for k in state.apply(seq, ts, v.astype(float))[2]]
        at += n
    want, hours = [], {}
    for seq, ts, v in rows:
        last = max([5 * HOUR_MS, *(t for s, t, _ in rows if s < seq)])
        want.append("beyond" if last - ts > 4 * HOUR_MS else "correction" if ts // HOUR_MS < last // HOUR_MS else "on_time")
        if want[-1] != "beyond":
            n, k, total = hours.get(ts - ts % HOUR_MS, (0, 0, 0.0))
            hours[ts - ts % HOUR_MS] = (n + 1, k + (v == v), total + (v if v == v else 0.0))
    assert kinds == want and {"beyond", "correction"} <= set(want)
    got, outputs = state.outputs()
    assert dict(zip(got.tolist(), zip(*outputs.tolist()))) == hours
    assert list(state.ts) == sorted(t for (_, t, _), k in zip(rows, want) if k != "beyond")
    assert state.replayed < len(rows) * (spacing + 40)


def test_copies_are_forgotten_with_the_cut_off():
    state = Replay(None, HOUR_MS)
    for seq in range(5000):
        state.add(seq, seq * 60_000, 1.0)
        state.forget()
    assert len(state.seen) < 1000 and state.add(4999, 4999 * 60_000, 1.0)[0] == "copy" and state.add(3, 180_000, 1.0)[0] == "beyond"


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_hot_keys_of_a_large_join(spark, how):
    """Beyond the bounds of a broadcast: a key with most rows is salted, with the result of a plain join."""
    big = spark.createDataFrame([("a" if i % 3 else f"k{i % 7}", i) for i in range(300)] + [(None, 5), ("a", 1)], "key string, i long")
    small = spark.createDataFrame([("a", 1), ("a", 2), ("k0", 3), ("k1", 3), ("zz", 4), (None, 9)], "key string, v long")
    want = sorted(map(repr, big.join(small, ["key"], how).collect()))
    assert sorted(map(repr, session.sized_join(big, small, ["key"], how, rows=1, task_rows=20).collect())) == want
    assert sorted(map(repr, session.sized_join(big, small, ["key"], how, rows=1, task_rows=1000).collect())) == want


def test_checkpoints_need_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"
        _jsc = property(lambda self: self)
        sc = getCheckpointDir = lambda self: self
        isDefined = lambda self: False

    class Session:
        sparkContext = Context()
        conf = property(lambda self: {})

    with pytest.raises(RuntimeError):
        session.shared_checkpoints(Session())
