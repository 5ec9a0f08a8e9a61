"""Older and newer neighbour of each row of a series, hot series split into blocks of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a block of time within which neighbours are looked up; rows at its edges take them from a small table.
BLOCK_MS = 86_400_000 * 4


def with_neighbours(rows: DataFrame, key: list[str], block_ms: int | Column = BLOCK_MS) -> DataFrame:
    """`rows` (key, ts, value, …) with prev_ts, prev_v, next_ts, next_v of the same key.

    The window runs within (key, block of time), so a key with a third of all rows is spread over its blocks. The
    first and last row of each block, a few rows per key, supply the neighbours across blocks.
    """
    blocked = rows.withColumn("_blk", F.floor(F.col("ts") / (F.lit(block_ms) if isinstance(block_ms, int) else block_ms)).cast("long"))
    edges = blocked.groupBy(*key, "_blk").agg(
        F.min("ts").alias("_f"), F.min_by("value", "ts").alias("_fv"), F.max("ts").alias("_l"), F.max_by("value", "ts").alias("_lv")
    )
    across = Window.partitionBy(*key).orderBy("_blk")
    edges = edges.select(
        *key,
        "_blk",
        F.lag("_l").over(across).alias("_pts"),
        F.lag("_lv").over(across).alias("_pv"),
        F.lead("_f").over(across).alias("_nts"),
        F.lead("_fv").over(across).alias("_nv"),
    )
    within = Window.partitionBy(*key, "_blk").orderBy("ts")
    near = blocked.select(
        *blocked.columns,
        F.lag("ts").over(within).alias("_a"),
        F.lag("value").over(within).alias("_av"),
        F.lead("ts").over(within).alias("_b"),
        F.lead("value").over(within).alias("_bv"),
    ).join(edges, [*key, "_blk"])
    return near.select(
        *rows.columns,
        F.coalesce("_a", "_pts").alias("prev_ts"),
        F.when(F.col("_a").isNotNull(), F.col("_av")).otherwise(F.col("_pv")).alias("prev_v"),
        F.coalesce("_b", "_nts").alias("next_ts"),
        F.when(F.col("_b").isNotNull(), F.col("_bv")).otherwise(F.col("_nv")).alias("next_v"),
    )
