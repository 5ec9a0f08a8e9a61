"""Streams against their batch counterparts."""

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import late as late_batch
from chronoloom.operators import rules
from chronoloom.operators.readings import HOUR_MS
from chronoloom.streaming import compaction, late, tail

SAMPLES = "series_key string, ts long, value double, seq long"


def feed(spark, folder, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SAMPLES).coalesce(1).write.parquet(f"{folder}/in/b{i}")
    return spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def run(df, name, folder):
    q = df.writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name).collect()


def test_compaction(spark, tmp_path):
    rows = [("s", t, float(t % 9), t) for t in range(0, 60, 2)]
    stream = feed(spark, tmp_path, [rows[:8], rows[8:20], rows[20:] + [("s", 3, 1.0, 99)]])
    rule = spark.createDataFrame([("s", "d", "sum", 10, 0), ("s", "e", "std.p", 20, 5)], rules.RULES)
    got = run(compaction.compact(stream, rule), "compacted", tmp_path)
    batch = spark.createDataFrame(rows, SAMPLES)
    want = {(r.dest_key, r.ts): r.value for r in rules.closed_buckets(batch, rule).collect()}
    closed = {(r.dest_key, r.ts): r.value for r in got if r.kind == "closed"}
    assert closed == pytest.approx(want)
    assert {(r.dest_key, r.ts) for r in got if r.kind == "late"} == {("d", 0), ("e", 0)}


def test_late_marks_make_all_buckets_of_twa(spark, tmp_path):
    parts = [[3, 4, 11, 38, 52], [61, 90, 95, 141], [24, 70, 140, 160]]  # 24 and 70 are late, in buckets of their own
    parts = [[("s", t, float(t * t % 17), t) for t in part] for part in parts]
    parts[1].append(("s", 171, float("nan"), 171))
    rule = spark.createDataFrame([("s", "d", "TWA", 10, 0)], rules.RULES)
    made, seen = {}, []

    def follow(batch, i):
        marks = {(r.dest_key, r.ts) for r in batch.collect() if r.kind == "late"}
        seen.append(marks)
        stored = spark.createDataFrame([r for part in parts[: i + 1] for r in part], SAMPLES)
        made.update({(r.dest_key, r.ts): r.value for r in rules.closed_buckets(stored, rule).collect() if (r.dest_key, r.ts) in marks})

    stream = compaction.compact(feed(spark, tmp_path, parts), rule)
    q = stream.writeStream.outputMode("update").foreachBatch(follow).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    want = {(r.dest_key, r.ts): r.value for r in rules.closed_buckets(spark.createDataFrame(sum(parts, []), SAMPLES), rule).collect()}
    assert made == pytest.approx(want) and len(want) > 8
    assert ("d", 0) in seen[0] and ("d", 0) not in seen[2]


def test_late_hours(spark, tmp_path):
    rows = [("s", 10 * HOUR_MS + i * HOUR_MS // 3, 1.0 + i, i) for i in range(30)]
    rows[20] = ("s", 11 * HOUR_MS, 50.0, 20)  # beyond the cut-off
    rows[25] = ("s", 17 * HOUR_MS, 70.0, 25)
    series = spark.createDataFrame([("s", None, 3 * HOUR_MS)], "series_key string, last_timestamp long, retention_ms long")
    got = run(late.corrected_hours(feed(spark, tmp_path, [rows[:10], rows[10:22], rows[22:]]), series), "late_hours", tmp_path)
    final = {}
    for r in got:
        if r.period_start not in final or r.n >= final[r.period_start].n:
            final[r.period_start] = r
    want = late_batch.corrected_hours(spark.createDataFrame(rows, SAMPLES), series).where("n > 0").collect()
    assert {(h, r.n, r.total, r.mean) for h, r in final.items()} == {(r.period_start, r.n, r.total, r.mean) for r in want}
    assert final[17 * HOUR_MS].kind == "correction"


def test_blocking_read(spark, tmp_path):
    stream = feed(spark, tmp_path, [[("s", t, float(t), t) for t in range(5)], [("s", t, float(t), t) for t in range(5, 9)]])
    assert [t for t, _ in tail.read_blocking(stream, "s", 2, least=5, most=6, timeout_ms=60_000)] == [2, 3, 4, 5, 6, 7]
    assert tail.read_blocking(stream, "s", 100, timeout_ms=1500) == []


def test_blocking_read_has_no_cap_of_its_own(spark, tmp_path):
    stream = feed(spark, tmp_path, [[("s", t, float(t), t) for t in range(2500)]])
    got = tail.read_blocking(stream, "s", 100, timeout_ms=60_000, checkpoint=f"{tmp_path}/cp")
    assert got == [(t, float(t)) for t in range(100, 2500)]
    assert [t for t, _ in tail.read_blocking(stream, "s", 100, most=7, timeout_ms=60_000)] == list(range(100, 107))


def test_blocking_read_tells_of_failure(spark, tmp_path):
    stream = feed(spark, tmp_path, [[("s", t, float(t), t) for t in range(5)]])
    broken = stream.withColumn("value", F.raise_error(F.lit("unreadable")).cast("double"))
    with pytest.raises(Exception, match="unreadable"):
        tail.read_blocking(broken, "s", timeout_ms=60_000)


def test_refresh_by_batches(spark, tmp_path):
    first = [("s", t, float(t), t) for t in range(0, 50, 5)]
    more = [("s", 12, 7.0, 100), ("s", 61, 1.0, 101)]
    rule = spark.createDataFrame([("s", "d", "sum", 10, 0)], rules.RULES)
    store = {"dest": rules.closed_buckets(spark.createDataFrame(first, SAMPLES), rule).withColumnRenamed("dest_key", "series_key")}
    everything = spark.createDataFrame(first + more, SAMPLES)
    sink = compaction.apply_batch(lambda: everything, lambda: store["dest"], lambda df: store.update(dest=df), rule)
    q = feed(spark, tmp_path, [more]).writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = rules.closed_buckets(everything, rule).select(F.col("dest_key").alias("series_key"), "ts", "value")
    assert {tuple(r) for r in store["dest"].select("series_key", "ts", "value").collect()} == {tuple(r) for r in want.collect()}
