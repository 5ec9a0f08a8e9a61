"""Sketches: error bounds, merging, the query operator, dirty rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import quantiles
from chronoloom.llm.quantiles import RelativeSketch


def ranks(sketch, values, at):
    s = np.sort(values)
    for q, v in zip(at, sketch.quantiles(at)):
        lo, hi = np.searchsorted(s, v, "left") / len(s), np.searchsorted(s, v, "right") / len(s)
        yield q, max(lo - q, q - hi, 0)


@pytest.mark.parametrize("kind", ["normal", "sorted", "reversed", "few", "constant"])
def test_rank_error(kind):
    rng = np.random.default_rng(1)
    x = {"normal": rng.normal(size=300_000), "sorted": np.arange(300_000.0), "reversed": -np.arange(300_000.0), "few": rng.integers(0, 9, 300_000) / 8, "constant": np.ones(300_000)}[kind]
    s = RelativeSketch()
    for part in np.array_split(x, 37):
        s.add(part)
    at = [0.001, 0.01, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999, 0.9999]
    for q, e in ranks(s, x, at):
        assert e <= 0.01 and e <= max(0.02 * (1 - q), 2 / len(x)), (q, e)  # a multiple of the distance to the protected end
    assert s.n == len(x) and sum(v.size for v in s.levels) < 9000


def test_low_tail():
    x = np.random.default_rng(2).exponential(size=200_000)
    s = RelativeSketch(high=False)
    s.add(x)
    assert all(e <= 0.02 * q + 1e-5 for q, e in ranks(s, x, [0.0001, 0.001, 0.01, 0.1, 0.5]))


def test_merge_and_bytes():
    rng = np.random.default_rng(3)
    parts = [rng.normal(i, 1, rng.integers(1, 30_000)) for i in range(40)]
    total = RelativeSketch()
    for i, p in enumerate(parts):
        s = RelativeSketch(seed=i + 1)
        s.add(p)
        back = RelativeSketch.from_bytes(s.to_bytes())
        assert back.quantiles([0.1, 0.9]) == s.quantiles([0.1, 0.9])
        total.merge(back)
    x = np.concatenate(parts)
    assert total.n == len(x)
    assert all(e <= 0.01 for _, e in ranks(total, x, [0.05, 0.5, 0.95, 0.99]))
    assert abs(total.rank(10.0) / len(x) - (x <= 10).mean()) < 0.01
    assert RelativeSketch().quantiles([0.5]) == [None]


def test_small_is_exact():
    s = RelativeSketch()
    s.add(np.array([5.0, 1.0, 3.0]))
    assert s.quantiles([0, 0.34, 0.5, 1]) == [1.0, 3.0, 3.0, 5.0]


def test_operator(spark):
    rng = np.random.default_rng(4)
    rows = [("hot", float(v)) for v in rng.normal(50, 9, 4000)] + [("cold", 1.0), ("cold", math.nan), ("cold", None), (None, 1.0), ("other", 7.0)]
    df = spark.createDataFrame(rows, "series_key string, value double").withColumn("key", F.lit(1)).withColumn("n", F.lit(1)).repartition(6)
    labels = spark.createDataFrame([("hot", "a"), ("hot", "a"), ("hot", "b"), ("cold", "b"), ("other", None), (None, "a"), ("absent", "c")], "series_key string, label_value string")
    got = {r.key: r for r in quantiles.read_quantiles(quantiles.label_sketches(df, labels), [0.5, 0.95]).collect()}
    assert {k: r.n for k, r in got.items()} == {"a": 4000, "b": 4001}
    hot = np.sort([v for k, v in rows if k == "hot"])
    assert abs(np.searchsorted(hot, got["a"].q[0]) / 4000 - 0.5) < 0.01 and abs(np.searchsorted(hot, got["a"].q[1]) / 4000 - 0.95) < 0.01
    assert quantiles.read_quantiles(quantiles.label_sketches(df.limit(0), labels), [0.5]).count() == 0


def test_days_combine(spark):
    rng = np.random.default_rng(5)
    days = [spark.createDataFrame([("k", float(v)) for v in rng.normal(d, 3, 1500)], "key string, value double") for d in range(3)]
    parts = [quantiles.merge_sketches(quantiles.sketch_partitions(d, "key", "value")) for d in days]
    both = quantiles.merge_sketches(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    x = np.sort(np.concatenate([[r.value for r in d.collect()] for d in days]))
    (r,) = quantiles.read_quantiles(both, [0.5, 0.9]).collect()
    assert r.n == 4500 and all(abs(np.searchsorted(x, v) / 4500 - q) < 0.01 for v, q in zip(r.q, (0.5, 0.9)))


def test_percentiles_of_every_label(spark, data):
    from chronoloom.llm.queries import p5_percentiles

    labels = spark.read.parquet(f"{data}/series_labels.parquet").where("label_key <> '' AND label_value <> ''").distinct()
    rows = spark.read.parquet(f"{data}/samples.parquet").where("NOT isnan(value)").select("series_key", "ts", "value").distinct()
    exact = {(r.label_key, r.label_value): np.sort(r.v) for r in rows.join(labels, "series_key").groupBy("label_key", "label_value").agg(F.collect_list("value").alias("v")).collect()}
    got = p5_percentiles(spark, data).collect()
    assert {(r.label_key, r.label_value): r.n for r in got} == {k: len(v) for k, v in exact.items()} and len(got) == len(exact)
    assert {"os", "unit", "tier", "agent", "hostname", "region"} <= {r.label_key for r in got}
    for r in got:
        x = exact[r.label_key, r.label_value]
        for q, v in ((0.5, r.p50), (0.9, r.p90), (0.95, r.p95), (0.99, r.p99)):
            lo, hi = np.searchsorted(x, v, "left") / len(x), np.searchsorted(x, v, "right") / len(x)
            assert lo - q <= 0.01 and q - hi <= 0.01, (r.label_key, r.label_value, q)
