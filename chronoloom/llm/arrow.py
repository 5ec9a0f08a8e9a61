"""Bounds for Arrow batches that carry whole texts."""

from __future__ import annotations

from pyspark.sql import SparkSession


def bound_batches(spark: SparkSession, nbytes: int = 16 << 20) -> None:
    """Hand texts to Python workers in batches of about `nbytes`, however long the texts are."""
    for name in ("spark.sql.execution.arrow.maxBytesPerBatch",):
        spark.conf.set(name, str(nbytes))
