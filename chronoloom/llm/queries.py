"""Queries of the four language-model data problems, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import bpe, cuts, leaks, quantiles
from chronoloom.operators.hotkeys import label_pairs
from chronoloom.operators.readings import readings
from chronoloom.plans.tables import table
from chronoloom.session import sized_join


def _values_of(labels: DataFrame, key: str) -> DataFrame:
    return labels.where((F.col("label_key") == key) & (F.col("label_value") != "")).select("series_key", "label_value").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Hosts whose percentages are mostly moderate but have a high 95th percentile."""
    labels = table(spark, d, "series_labels")
    pct = labels.where((F.col("label_key") == "unit") & (F.col("label_value") == "pct")).select("series_key").distinct()
    hosts = _values_of(labels, "hostname").join(pct, "series_key", "left_semi")
    rows = readings(sized_join(table(spark, d, "samples"), hosts.select("series_key").distinct(), ["series_key"], "left_semi"))
    q = quantiles.read_quantiles(quantiles.label_sketches(rows, hosts), [0.5, 0.95])
    return q.where((F.col("n") >= 200) & (F.col("q")[0] <= 60) & (F.col("q")[1] >= 85)).select(F.col("key").alias("label_value"))


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of the readings of every value of every label; null and empty keys or values are no labels."""
    keyed = label_pairs(table(spark, d, "series_labels"))
    keyed = keyed.select("series_key", F.to_json(F.struct("label_key", "label_value")).alias("label_value"))
    q = quantiles.read_quantiles(quantiles.label_sketches(readings(table(spark, d, "samples")), keyed), [0.5, 0.9, 0.95, 0.99])
    name = F.from_json("key", "label_key string, label_value string")
    return q.select(name["label_key"].alias("label_key"), name["label_value"].alias("label_value"), "n", *[F.col("q")[i].alias(c) for i, c in enumerate(("p50", "p90", "p95", "p99"))])


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """Pages, and the greatest share found, of every item that leaked."""
    found = leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("pages"), F.round(F.max("share"), 6).alias("greatest_share"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return cuts.cut_documents(table(spark, d, "documents"))


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each source cuts."""
    return cuts.cut_rates(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p5_found, p5_percentiles, p6_ids, p7_found, p7_leaked_items, p8_found, p8_rates)}

ORACLES = {
    "p5_found": """WITH h AS (SELECT DISTINCT series_key, label_value FROM series_labels WHERE label_key = 'hostname' AND label_value <> ''
  AND series_key IN (SELECT series_key FROM series_labels WHERE label_key = 'unit' AND label_value = 'pct')),
r AS (SELECT DISTINCT series_key, ts, value FROM samples WHERE NOT isnan(value))
SELECT label_value FROM r JOIN h USING (series_key) GROUP BY ALL
HAVING count(*) >= 200 AND quantile_disc(value, 0.5) <= 60 AND quantile_disc(value, 0.95) >= 85""",
}
