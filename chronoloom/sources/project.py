"""Series out of the tables of a data folder."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.model import TimeSeries
from chronoloom.plans.tables import table


def millis(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, read as UTC, exact on microseconds."""
    return F.unix_millis(F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts).cast("timestamp"))


#: Time tags from here on are beyond what a timestamp literal holds.
_LATEST = 253_402_300_799_000


def _stored(ms: int) -> Column:
    """The timestamp without zone that `millis` maps to `ms`."""
    at = datetime(1970, 1, 1) + timedelta(milliseconds=ms)
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def _catalog(rows: DataFrame, labels: dict[str, str], measurement: str, retention: Column | None = None) -> DataFrame:
    """One catalog row per series of `rows`; the labels are columns of it."""
    pairs = [x for k, c in labels.items() for x in (F.lit(k), F.col(c).cast("string"))]
    keys = rows.select("series_key", *labels.values()).distinct()
    out = keys.select("series_key", F.create_map(F.lit("measurement"), F.lit(measurement), *pairs).alias("labels"))
    return out.withColumns({"retention_ms": F.lit(0).cast("long") if retention is None else retention, "source_key": F.lit(None).cast("string")})


def events(spark: SparkSession, folder: str, retention_ms: int = 0) -> TimeSeries:
    """One series per event type and user."""
    rows = table(spark, folder, "events")
    key = F.concat(F.lit("events:"), F.col("event_type"), F.lit(":"), F.col("user_id").cast("string"))
    rows = rows.select(key.alias("series_key"), "event_type", "user_id", millis(F.col("ts")).alias("ts"), "value")
    cat = _catalog(rows, {"event_type": "event_type", "user_id": "user_id"}, "events", F.lit(retention_ms).cast("long"))

    def scan(wanted: str | None, lo: int, hi: int) -> DataFrame:
        """Filters on the columns as they are stored; the bounds are whole milliseconds."""
        raw = table(spark, folder, "events")
        if lo > 0:
            raw = raw.where(F.col("ts") >= _stored(lo))
        if hi < _LATEST:
            raw = raw.where(F.col("ts") < _stored(hi + 1))
        if wanted is not None:
            kind, _, user = wanted.removeprefix("events:").rpartition(":")
            raw = raw.where((F.col("event_type") == kind) & (F.col("user_id") == (int(user) if user.lstrip("-").isdigit() else None)) & (key == wanted))
        return raw.select(key.alias("series_key"), millis(F.col("ts")).alias("ts"), "value")

    return TimeSeries(rows.select("series_key", "ts", "value"), cat, scan=scan)


def orders(spark: SparkSession, folder: str) -> TimeSeries:
    """One series per order priority and status: the greatest total price of each time tag."""
    rows = table(spark, folder, "orders")
    key = F.concat_ws(":", F.lit("orders"), "o_orderpriority", "o_orderstatus")
    rows = rows.select(key.alias("series_key"), "o_orderpriority", "o_orderstatus", millis(F.col("o_orderdate")).alias("ts"), F.col("o_totalprice").alias("value"))
    cat = _catalog(rows, {"priority": "o_orderpriority", "status": "o_orderstatus"}, "orders")
    return TimeSeries(rows.groupBy("series_key", "ts").agg(F.max("value").alias("value")), cat)


def shipments(spark: SparkSession, folder: str) -> DataFrame:
    """An arrival log with natural duplicates: a series per supplier, a row per shipment, in order of order and line."""
    rows = table(spark, folder, "lineitem")
    return rows.select(
        F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("series_key"),
        millis(F.col("l_shipdate")).alias("ts"),
        F.col("l_quantity").alias("value"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"),
    )


def monitoring(spark: SparkSession, folder: str) -> TimeSeries:
    """The catalog, samples and rules of the monitoring tables; of equal time tags the greatest value is kept."""
    rows = table(spark, folder, "samples").groupBy("series_key", "ts").agg(F.max("value").alias("value"))
    return TimeSeries(rows, table(spark, folder, "series"), table(spark, folder, "rules"))
