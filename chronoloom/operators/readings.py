"""Readings: the distinct rows of samples whose value is a number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.session import TASK_ROWS, checkpointed, sized_join

DAY_MS = 86_400_000
HOUR_MS = 3_600_000


def floor_to(ts: Column, width: Column | int, align: Column | int = 0) -> Column:
    """Start of the bucket of `ts`: buckets start at `align` plus whole multiples of `width`."""
    w = F.lit(width) if isinstance(width, int) else width
    a = F.lit(align) if isinstance(align, int) else align
    return ts - F.pmod(ts - a, w)


def day_number(ts: Column) -> Column:
    """UTC day number, with floor semantics before 1970."""
    return ((ts - F.pmod(ts, F.lit(DAY_MS))) / F.lit(DAY_MS)).cast("long")


def numbers(samples: DataFrame) -> DataFrame:
    """Rows with a key, a time and a number (neither null nor NaN); repeats are kept."""
    v = F.col("value").cast("double")
    return samples.select("series_key", F.col("ts").cast("long").alias("ts"), v.alias("value")).where(
        F.col("series_key").isNotNull() & F.col("ts").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value")
    )


def hot_days(rows: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame | None:
    """Days of a series with more than `task_rows` rows (series_key, day, _k: the number of tasks to spread them over).

    Series with fewer rows in all are ruled out by a count that leaves a row per series and task.
    """
    n = F.count("*").alias("n")
    series = checkpointed(rows.groupBy("series_key").agg(n).where(F.col("n") > task_rows).select("series_key"))
    if series.isEmpty():
        return None
    mine = sized_join(rows, series, ["series_key"], "left_semi").groupBy("series_key", day_number(F.col("ts")).alias("day")).agg(n)
    days = checkpointed(mine.where(F.col("n") > task_rows).select("series_key", "day", F.ceil(F.col("n") / F.lit(task_rows)).alias("_k")))
    return None if days.isEmpty() else days


def readings(samples: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Distinct (series_key, ts, value) of `samples`, with their UTC `day`.

    One shuffle: rows are spread by (series, day), which clusters equal rows, so the distinct and any later
    aggregation by (series, day) need no further exchange, and a hot series is spread over its days. Where a day of a
    series has more than `task_rows` rows, its rows are spread by a hash of the time tag as well; what is then
    aggregated by (series, day) is shuffled once more as partial results.
    """
    rows = numbers(samples)
    hot = hot_days(rows, task_rows)
    rows = rows.withColumn("day", day_number(F.col("ts")))
    if hot is None:
        return rows.repartition("series_key", "day").distinct()
    rows = sized_join(rows, hot, ["series_key", "day"], "left", salt_of=["ts"])
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("ts"), F.coalesce("_k", F.lit(1).cast("long")))).drop("_k")
    return rows.repartition("series_key", "day", "_salt").distinct().select("series_key", "ts", "value", "day")
