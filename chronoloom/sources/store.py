"""Series on disk: parquet laid out for time-range and key pruning, and CSV with wide rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.model import TimeSeries, catalog

#: Width of a partition folder.
FOLDER_MS = 30 * 86_400_000


def save(ts: TimeSeries, path: str, files: int | None = None) -> None:
    """Writes samples, catalog and rules below `path`.

    Samples are partitioned by blocks of time and range-partitioned and sorted by (series_key, ts), so a scan of a
    few series or of a range reads few row groups. A hot series is spread over its blocks of time.
    """
    rows = ts.samples.select("series_key", "ts", "value").withColumn("block", F.floor(F.col("ts") / F.lit(FOLDER_MS)).cast("long"))
    n = [files] if files else []
    rows.repartitionByRange(*n, "block", "series_key", "ts").sortWithinPartitions("block", "series_key", "ts").write.mode("overwrite").partitionBy("block").parquet(f"{path}/samples")
    catalog(ts.series).write.mode("overwrite").parquet(f"{path}/series")
    if ts.rules is not None:
        ts.rules.write.mode("overwrite").parquet(f"{path}/rules")


def load(spark: SparkSession, path: str, rules: bool = False) -> TimeSeries:
    """Reads what `save` wrote."""
    samples = spark.read.parquet(f"{path}/samples")
    return TimeSeries(samples.select("series_key", "ts", "value", "block").drop("block"), spark.read.parquet(f"{path}/series"), spark.read.parquet(f"{path}/rules") if rules else None)


def scan(spark: SparkSession, path: str, lo: int, hi: int) -> DataFrame:
    """Samples of [lo, hi], with the folders outside of it pruned."""
    rows = spark.read.parquet(f"{path}/samples")
    return rows.where(F.col("block").between(lo // FOLDER_MS, hi // FOLDER_MS) & F.col("ts").between(lo, hi)).select("series_key", "ts", "value")


def read_csv(spark: SparkSession, path: str, time: str, values: dict[str, str], labels: dict[str, str], schema: str, prefix: str = "csv") -> TimeSeries:
    """Series out of CSV: one per combination of label columns and value column.

    `values` maps a value column to the name of its field label, `labels` a label to its column; rows whose time or
    value can't be read are left out.
    """
    rows = spark.read.csv(path, header=True, schema=schema)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).cast("double").alias("value")) for c, f in values.items()])).alias("_v")
    rows = rows.select(*{c for c in labels.values()}, F.unix_millis(F.col(time).cast("timestamp")).alias("ts"), each)
    rows = rows.select("*", F.col("_v.field").alias("_f"), F.col("_v.value").alias("value")).where(F.col("ts").isNotNull() & F.col("value").isNotNull())
    key = F.concat_ws(":", F.lit(prefix), F.col("_f"), *[F.col(c).cast("string") for c in labels.values()])
    rows = rows.withColumn("series_key", key)
    pairs = [x for k, c in labels.items() for x in (F.lit(k), F.col(c).cast("string"))]
    cat = rows.select("series_key", F.create_map(F.lit("field"), F.col("_f"), *pairs).alias("labels"), F.lit(0).cast("long").alias("retention_ms")).dropDuplicates(["series_key"])
    return TimeSeries(rows.groupBy("series_key", "ts").agg(F.max("value").alias("value")), cat)
