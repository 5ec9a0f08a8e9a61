"""Golden values of range scans and bucketed aggregation."""

import math
import random

import pytest

from chronoloom.functions.aggregates import NAMES
from chronoloom.operators.ranges import range_query
from chronoloom.plans.specs import Buckets, RangeSpec

NAN = float("nan")


def rows(ts, spec, key="s"):
    return [tuple(r) for r in range_query(ts, key, spec).collect()]


def same(got, want, tol=1e-9):
    assert len(got) == len(want), (got, want)
    for g, w in zip(got, want):
        for a, b in zip(g, w):
            assert (math.isnan(a) and math.isnan(b)) or abs(a - b) <= tol * max(1, abs(b)), (got, want)


@pytest.fixture(scope="module")
def gaps(make):
    return make({"s": ({}, [(15, 1), (17, 4), (51, 3), (73, 5), (75, 3)])})


def test_scan_and_retention(make):
    t0 = 1488823384
    ts = make({"s": ({}, [(t0 + i, 5) for i in range(1500)], {"retention_ms": 1400})})
    got = rows(ts, RangeSpec(t0 + 50, t0 + 150))
    assert [r[0] for r in got] == list(range(t0 + 99, t0 + 151))
    assert rows(ts, RangeSpec(t0 + 50, t0 + 150, reverse=True)) == got[::-1]
    assert rows(ts, RangeSpec(count=2, reverse=True))[0][0] == t0 + 1499


def test_count_of_constant_series(make):
    t0 = 1488823384
    ts = make({"s": ({}, [(t0 + i, 5) for i in range(1500)])})
    got = rows(ts, RangeSpec(t0, t0 + 1500, buckets=Buckets(("count",), 500)))
    assert got == [(1488823000, 116.0), (1488823500, 500.0), (1488824000, 500.0), (1488824500, 384.0)]


def test_filters(make):
    t0 = 1511885909
    ts = make({"s": ({}, [(t0 + i, i) for i in range(1500)])})
    assert len(rows(ts, RangeSpec(values=(40.0, 52.0)))) == 13
    times = tuple(t0 + i for i in (1021, 1022, 1025, 1029))
    assert [r[1] for r in rows(ts, RangeSpec(times=times))] == [1021, 1022, 1025, 1029]
    assert [r[1] for r in rows(ts, RangeSpec(times=(*times, t0 + 1023), values=(1022.0, 1025.0)))] == [1022, 1023, 1025]


DECADE = [31, 41, 59, 26, 53, 58, 97, 93, 23, 84]


@pytest.mark.parametrize(
    "name,want",
    [("std.p", [25.869] * 4), ("std.s", [27.269] * 4), ("var.p", [669.25] * 4), ("var.s", [743.611] * 4), ("sum", [1565, 2565, 3565, 4565]), ("count", [10] * 4), ("first", [131, 231, 331, 431]),
     ("last", [184, 284, 384, 484]), ("range", [74] * 4), ("min", [123, 223, 323, 423]), ("max", [197, 297, 397, 497]), ("avg", [156.5, 256.5, 356.5, 456.5])],
)
def test_decades(make, name, want):
    ts = make({"s": ({}, [(i, (i // 10) * 100 + DECADE[i % 10]) for i in range(10, 50)])})
    same(rows(ts, RangeSpec(buckets=Buckets((name,), 10))), [(10 * (i + 1), w) for i, w in enumerate(want)], 1e-4)


def test_nan_triple(make):
    ts = make({"s": ({}, [(10, 10), (20, NAN), (30, 20)])})
    want = dict(avg=15, sum=30, min=10, max=20, range=10, count=2, countnan=1, countall=3, first=10, last=20) | {"std.p": 5, "std.s": math.sqrt(50), "var.p": 25, "var.s": 50}
    for name, v in want.items():
        same(rows(ts, RangeSpec(buckets=Buckets((name,), 100))), [(0, v)])
    many = rows(ts, RangeSpec(buckets=Buckets(tuple(want), 100)))
    same(many, [(0, *want.values())])


def test_sandwich(make):
    ts = make({"s": ({}, [(10, 100), (30, 200)])})
    want = {n: NAN for n in NAMES} | dict(sum=0, count=0, countnan=0, countall=0, last=100, twa=175)
    for name, v in want.items():
        got = {r[0]: r[1] for r in rows(ts, RangeSpec(0, 39, buckets=Buckets((name,), 10, 0, empty=True)))}
        if name == "twa":
            assert abs(got[20] - 175) < 1e-9
        elif name in ("countnan",):
            assert got == {}or got.get(20, 0) == 0
        else:
            same([(got[20],)], [(v,)])


def test_gap_filling(gaps):
    spec = lambda n: RangeSpec(0, 100, buckets=Buckets((n,), 10, 0, empty=True))
    same(rows(gaps, spec("max")), [(10, 4), (20, NAN), (30, NAN), (40, NAN), (50, 3), (60, NAN), (70, 5)])
    assert [r[1] for r in rows(gaps, spec("last"))] == [4, 4, 4, 4, 3, 3, 3]
    assert [r[1] for r in rows(gaps, spec("sum"))] == [5, 0, 0, 0, 3, 0, 8]


def test_bucket_labels(gaps):
    for label, want in (("start", [10, 50, 70]), ("~", [15, 55, 75]), ("+", [20, 60, 80])):
        assert [r[0] for r in rows(gaps, RangeSpec(0, 100, buckets=Buckets(("max",), 10, label=label)))] == want


@pytest.mark.parametrize(
    "lo,hi,want",
    [(11, 16, [(t, 100) for t in range(11, 17)]), (8, 12, [(10, 100), (11, 100), (12, 100)]), (18, 22, [(18, 100), (19, 100), (20, 110)]),
     (13, 20, [(t, 100) for t in range(13, 20)] + [(20, 110)]), (2, 5, []), (25, 30, [])],
)
def test_edge_gaps(make, lo, hi, want):
    ts = make({"s": ({}, [(10, 100), (20, 110)])})
    same(rows(ts, RangeSpec(lo, hi, buckets=Buckets(("last",), 1, empty=True))), want)


def test_edge_gaps_twa(make):
    ts = make({"s": ({}, [(10, 100), (20, 110)])})
    same([r[1:] for r in rows(ts, RangeSpec(11, 16, buckets=Buckets(("twa",), 1, empty=True)))], [(x,) for x in (101.5, 102.5, 103.5, 104.5, 105.5, 106)])


def test_aligned_gaps(make):
    ts = make({"s": ({}, [(12, 100), (42, 200)])})
    assert rows(ts, RangeSpec(0, 60, buckets=Buckets(("last",), 5, 2, empty=True))) == [(t, 100) for t in range(12, 42, 5)] + [(42, 200)]
    assert [r[1] for r in rows(ts, RangeSpec(0, 60, buckets=Buckets(("sum",), 5, 2, empty=True)))] == [100, 0, 0, 0, 0, 0, 200]


@pytest.mark.parametrize(
    "samples,lo,hi,want",
    [([(8, 8), (9, 9), (10, 10), (13, 13), (14, 14), (23, 23)], 10, 20, 15), ([(13, 13), (28, 28)], 10, 20, 16.5), ([(3, 3), (17, 17)], 10, 20, 13.5), ([(15, 15)], 10, 20, 15), ([(0, 5), (9, 12)], 0, 10, 8.5)],
)
def test_twa(make, samples, lo, hi, want):
    ts = make({"s": ({}, samples)})
    same(rows(ts, RangeSpec(lo, hi, buckets=Buckets(("twa",), 10)))[:1], [(lo, want)])


def test_twa_with_gaps(make):
    b = Buckets(("twa",), 10, empty=True)
    same(rows(make({"s": ({}, [(20, 100), (50, 130)])}), RangeSpec(20, 50, buckets=b)), [(20, 105), (30, 115), (40, 125), (50, 130)])
    same(rows(make({"s": ({}, [(40, 100), (50, 130)])}), RangeSpec(29, 70, buckets=b)), [(40, 115), (50, 130)])


def test_mixed_validators(make):
    ts = make({"s": ({}, [(1000, 10), (1001, NAN), (1002, 20), (1003, NAN), (1004, 30)])})
    assert rows(ts, RangeSpec(buckets=Buckets(("sum", "countnan", "countall"), 1000))) == [(1000, 60.0, 2.0, 5.0)]


def oracle(samples, lo, hi, name, d, align, empty):
    """The rules of bucketed aggregation and gap filling in plain Python (all but twa)."""
    start = lambda t: t - (t - align) % d
    inside = [(t, v) for t, v in samples if lo <= t <= hi]
    held = {}
    for t, v in inside:
        held.setdefault(start(t), []).append((t, v))
    real = [(t, v) for t, v in samples if not math.isnan(v)]
    around = lambda x: any(t < x for t, _ in real) and any(t >= x for t, _ in real)
    buckets = sorted(held)
    if empty:
        if buckets:
            first, last = buckets[0], buckets[-1]
            if start(lo) < first and around(max(start(lo), lo)):
                first = start(lo)
            if start(hi) > last and around(max(last + d, lo)):
                last = start(hi)
            buckets = list(range(first, last + 1, d))
        elif around(lo):
            buckets = list(range(start(lo), start(hi) + 1, d))
    out = []
    for b in buckets:
        vs = [v for _, v in held.get(b, []) if not math.isnan(v)]
        if not vs:
            if not empty:
                continue
            older = [v for t, v in real if t < max(b, lo)]
            v = 0.0 if name in ("sum", "count") else older[-1] if name == "last" and older else NAN
        else:
            v = {"sum": sum(vs), "count": len(vs), "min": min(vs), "max": max(vs), "last": vs[-1], "first": vs[0], "avg": sum(vs) / len(vs)}[name]
        out.append((max(b, 0), float(v)))
    return out


def test_against_plain_python(make):
    rng = random.Random(5)
    for _ in range(5):
        samples = [(t, NAN if rng.random() < 0.1 else float(rng.randint(-50, 50))) for t in sorted(rng.sample(range(200), rng.randint(1, 25)))]
        ts = make({"s": ({}, samples)})
        lo, d = rng.randint(0, 120), rng.randint(1, 20)
        hi, align, empty = lo + rng.randint(0, 80), rng.randint(0, 12), rng.random() < 0.7
        names = ("sum", "count", "min", "max", "last", "first", "avg")
        got = rows(ts, RangeSpec(lo, hi, buckets=Buckets(names, d, align, empty=empty)))
        for i, name in enumerate(names):
            want = oracle(samples, lo, hi, name, d, align, empty)
            same([(r[0], r[1 + i]) for r in got], want)
        reverse = rows(ts, RangeSpec(lo, hi, buckets=Buckets(names, d, align, empty=empty), reverse=True))
        same(reverse, got[::-1])


def test_bad_requests():
    for bad in (lambda: Buckets(("nope",), 10), lambda: Buckets(("sum",), 0), lambda: Buckets(("sum",) * 17, 1), lambda: Buckets(("sum",), 1, label="x"), lambda: RangeSpec(count=0), lambda: RangeSpec(-1, 5),
                lambda: RangeSpec(buckets=Buckets(("sum",), 1, "start"))):
        with pytest.raises(ValueError):
            bad()
