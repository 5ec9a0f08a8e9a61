"""Per-key count, sum, least and greatest value when a few keys hold most rows.

Dense accumulator arrays. Every task reads an equal split of the input, whatever keys it holds, dictionary-encodes
the keys it meets and scatter-reduces the values into dense arrays indexed by the code (numpy bincount, minimum.at,
maximum.at). It gives out the arrays in blocks by a hash of the key; blocks of all splits are then added up per
key. A key with a third of all rows costs each task the same as any other: one slot of its arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A task gives its arrays out and starts anew when it has met so many keys; bounds its memory, changes no result.
SLOTS = 1 << 18
STATS = "n long, numbers long, total double, least double, greatest double"
BLOCKS = "block int, keys array<string>, n array<long>, numbers array<long>, total array<double>, least array<double>, greatest array<double>"


class Dense:
    """Dense accumulators for the keys met so far."""

    def __init__(self) -> None:
        self.codes: dict[str, int] = {}
        self.n = np.zeros(1024, np.int64)
        self.numbers = np.zeros(1024, np.int64)
        self.total = np.zeros(1024)
        self.least = np.full(1024, np.inf)
        self.greatest = np.full(1024, -np.inf)

    def encode(self, keys: pa.Array) -> np.ndarray:
        """Codes of `keys` (no nulls)."""
        d = keys.dictionary_encode()
        get = self.codes
        local = np.array([get.setdefault(k, len(get)) for k in d.dictionary.to_pylist()], np.int64)
        if len(get) > len(self.n):
            size = 1 << (len(get) - 1).bit_length()
            for name, fill in (("n", 0), ("numbers", 0), ("total", 0.0), ("least", np.inf), ("greatest", -np.inf)):
                old = getattr(self, name)
                new = np.full(size, fill, old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)
        return local[d.indices.to_numpy(zero_copy_only=False)] if len(d) else np.zeros(0, np.int64)

    def add_values(self, codes: np.ndarray, values: np.ndarray) -> None:
        size = len(self.codes)
        self.n[:size] += np.bincount(codes, minlength=size)
        real = ~np.isnan(values)
        codes, values = codes[real], values[real]
        self.numbers[:size] += np.bincount(codes, minlength=size)
        self.total[:size] += np.bincount(codes, weights=values, minlength=size)
        np.minimum.at(self.least, codes, values)
        np.maximum.at(self.greatest, codes, values)

    def add_partials(self, codes: np.ndarray, n: np.ndarray, numbers: np.ndarray, total: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> None:
        np.add.at(self.n, codes, n)
        np.add.at(self.numbers, codes, numbers)
        np.add.at(self.total, codes, total)
        np.minimum.at(self.least, codes, least)
        np.maximum.at(self.greatest, codes, greatest)

    def arrays(self) -> tuple[list[str], list[np.ndarray]]:
        k = len(self.codes)
        return list(self.codes), [a[:k] for a in (self.n, self.numbers, self.total, self.least, self.greatest)]


def _doubles(col: pa.Array, null: float = np.nan) -> np.ndarray:
    return pc.fill_null(col.cast(pa.float64()), null).to_numpy(zero_copy_only=False)


def _longs(col: pa.Array) -> np.ndarray:
    return pc.fill_null(col.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)


def _block_rows(acc: Dense, blocks: int) -> pa.RecordBatch:
    keys, parts = acc.arrays()
    import zlib

    at = np.fromiter((zlib.crc32(k.encode()) % blocks for k in keys), np.int64, len(keys))
    order = np.argsort(at, kind="stable")
    ids, starts = np.unique(at[order], return_index=True)
    offsets = pa.array(np.append(starts, len(keys)).astype(np.int32))
    cols = [pa.ListArray.from_arrays(offsets, pa.array(keys, pa.string()).take(pa.array(order)))]
    cols += [pa.ListArray.from_arrays(offsets, pa.array(p[order])) for p in parts]
    return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), *cols], names=["block", "keys", "n", "numbers", "total", "least", "greatest"])


def _split_to_blocks(blocks: int, partial: bool, slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = Dense()
        for b in batches:
            codes = acc.encode(b.column(0))
            if partial:
                acc.add_partials(codes, _longs(b.column(1)), _longs(b.column(2)), _doubles(b.column(3), 0.0), _doubles(b.column(4), np.inf), _doubles(b.column(5), -np.inf))
            else:
                acc.add_values(codes, _doubles(b.column(1)))
            if len(acc.codes) >= slots:
                yield _block_rows(acc, blocks)
                acc = Dense()
        if acc.codes:
            yield _block_rows(acc, blocks)

    return run


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the blocks of a partition; a block's keys are in no other partition."""
    acc = Dense()
    for b in batches:
        flat = [b.column(i).flatten() for i in range(1, 7)]
        codes = acc.encode(flat[0])
        acc.add_partials(codes, _longs(flat[1]), _longs(flat[2]), _doubles(flat[3], 0.0), _doubles(flat[4], np.inf), _doubles(flat[5], -np.inf))
    keys, (n, numbers, total, least, greatest) = acc.arrays()
    for i in range(0, len(keys), 10_000):
        s = slice(i, i + 10_000)
        none = numbers[s] == 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[s], pa.string()), pa.array(n[s]), pa.array(numbers[s]), *(pa.array(a[s], mask=none) for a in (total, least, greatest))],
            names=["key", "n", "numbers", "total", "least", "greatest"],
        )


def dense_reduce(rows: DataFrame, key: str, value: str | None = None, blocks: int | None = None, slots: int = SLOTS) -> DataFrame:
    """Per key: n (all rows), numbers (rows that are neither null nor NaN), total, least and greatest of the numbers.

    With `value` None, `rows` holds accumulators (columns n, numbers, total, least, greatest) that are added up.
    Rows with a null key are left out; a key without a number has null total, least and greatest. No rows give no
    rows; other columns are ignored.
    """
    spark = rows.sparkSession
    blocks = blocks or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    if value is None:
        inputs = rows.select(F.col(key).cast("string").alias("key"), "n", "numbers", "total", "least", "greatest")
    else:
        inputs = rows.select(F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value"))
    parts = inputs.where(F.col("key").isNotNull()).mapInArrow(_split_to_blocks(blocks, value is None, slots), BLOCKS)
    return parts.repartition("block").mapInArrow(_add_blocks, f"key string, {STATS}")


def label_pairs(labels: DataFrame) -> DataFrame:
    """Distinct pairs per series; null and empty keys or values are no labels, case and spaces matter."""
    return labels.where((F.col("label_key") != "") & (F.col("label_value") != "") & F.col("series_key").isNotNull()).select("series_key", "label_key", "label_value").distinct()


def pair_totals(samples: DataFrame, labels: DataFrame) -> DataFrame:
    """n, numbers, total, least and greatest of the raw samples of each (label_key, label_value).

    All stored rows count, repeats and NaN (in n only) included; a pair counts once per series.
    """
    per_series = dense_reduce(samples, "series_key", "value").withColumnRenamed("key", "series_key")
    rows = per_series.join(label_pairs(labels), "series_key").withColumn("_pair", F.to_json(F.struct(F.col("label_key").alias("k"), F.col("label_value").alias("v"))))
    out = dense_reduce(rows, "_pair")
    pair = F.from_json("key", "k string, v string")
    return out.select(pair["k"].alias("label_key"), pair["v"].alias("label_value"), "n", "numbers", "total", "least", "greatest")


def heavy_pairs(samples: DataFrame, labels: DataFrame, one_in: int = 20) -> DataFrame:
    """Pairs whose series hold at least one in `one_in` of all rows of samples, unlabelled series included."""
    everything = samples.agg(F.count(F.lit(1)).alias("n")).scalar()
    return pair_totals(samples, labels).where(F.col("n") * one_in >= everything).where(F.col("n") > 0).select("label_key", "label_value")
