"""Quantiles with bounded relative rank error, in sketches that merge.

A sketch is a stack of relative-rank compactors (Cormode, Karnin, Liberty, Thaler, Vesely: Relative Error Streaming
Quantiles, 2021). Level h holds values of weight 2**h. A full level sorts its values, keeps those of the protected
tail and promotes every other one of the rest, so ranks near that tail keep a multiplicative error. Which part is
compacted follows a schedule (the trailing ones of a counter), which carries over when sketches of days, files or
partitions are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Section size. 64 keeps rank errors well under one percent (tests measure it).
K = 64
SECTIONS = 3
SKETCH = "n long, sketch binary"


class Level:
    """One compactor."""

    __slots__ = ("parts", "size", "k", "sections", "state")

    def __init__(self, k: float, sections: int = SECTIONS, state: int = 0) -> None:
        self.parts: list[np.ndarray] = []
        self.size, self.k, self.sections, self.state = 0, k, sections, state

    def add(self, values: np.ndarray) -> None:
        if len(values):
            self.parts.append(values)
            self.size += len(values)

    def values(self) -> np.ndarray:
        if len(self.parts) != 1:
            self.parts = [np.concatenate(self.parts) if self.parts else np.zeros(0)]
        return self.parts[0]

    def section(self) -> int:
        return max(4, 2 * round(self.k / 2))

    def capacity(self) -> int:
        return 2 * self.section() * self.sections

    def compact(self, high: bool, coin: int) -> np.ndarray:
        """The promoted half of what is compacted; the protected tail stays."""
        ones = ((~self.state) & (self.state + 1)).bit_length() - 1
        free = min(ones + 1, self.sections)
        kept = self.capacity() // 2 + (self.sections - free) * self.section()
        v = np.sort(self.values())
        rest = max(0, len(v) - kept)
        rest -= rest % 2
        low, top = (v[:rest], v[rest:]) if high else (v[len(v) - rest :], v[: len(v) - rest])
        self.parts, self.size = [top], len(top)
        self.state += 1
        if self.state >= 1 << (self.sections - 1) and self.section() > 4:
            self.k /= math.sqrt(2)
            self.sections *= 2
        return low[coin::2]


class RelativeSketch:
    """Mergeable sketch; `high` protects the greatest values, else the least."""

    def __init__(self, k: int = K, high: bool = True, seed: int = 0) -> None:
        self.k, self.high, self.n = k, high, 0
        self.levels = [Level(k)]
        self._coin = seed or 1

    def _flip(self) -> int:
        # xorshift: repeatable, and unrelated to the values
        x = self._coin
        x ^= (x << 13) & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 7
        x ^= (x << 17) & 0xFFFFFFFFFFFFFFFF
        self._coin = x
        return (x >> 11) & 1

    def _settle(self) -> None:
        h = 0
        while h < len(self.levels):
            while self.levels[h].size > self.levels[h].capacity():
                if h + 1 == len(self.levels):
                    self.levels.append(Level(self.k))
                self.levels[h + 1].add(self.levels[h].compact(self.high, self._flip()))
            h += 1

    def add(self, values: np.ndarray) -> None:
        """Adds numbers (no NaN)."""
        self.n += len(values)
        self.levels[0].add(np.asarray(values, np.float64))
        if self.levels[0].size > self.levels[0].capacity():
            self._settle()

    def merge(self, other: RelativeSketch) -> None:
        self.n += other.n
        self._coin ^= (other._coin * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        self._coin = self._coin or 1
        while len(self.levels) < len(other.levels):
            self.levels.append(Level(self.k))
        for a, b in zip(self.levels, other.levels):
            a.state |= b.state
            if b.sections > a.sections:
                a.sections, a.k = b.sections, b.k
            for p in b.parts:
                a.add(p)
        self._settle()

    def weighted(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted values and the ranks reached with them."""
        values = np.concatenate([x.values() for x in self.levels])
        weights = np.concatenate([np.full(x.size, 1 << h, np.int64) for h, x in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        return values[order], np.cumsum(weights[order])

    def quantiles(self, at: list[float]) -> list[float | None]:
        """For each q the least value whose rank is at least q * n; None without values."""
        if not self.n:
            return [None] * len(at)
        values, ranks = self.weighted()
        goal = np.maximum(1, np.ceil(np.asarray(at) * ranks[-1]))
        return values[np.minimum(np.searchsorted(ranks, goal), len(values) - 1)].tolist()

    def rank(self, value: float) -> int:
        """Estimated number of values that are at most `value`."""
        values, ranks = self.weighted()
        i = int(np.searchsorted(values, value, "right"))
        return int(ranks[i - 1]) if i else 0

    def to_bytes(self) -> bytes:
        head = [self.n, self.k, int(self.high), self._coin & 0x7FFFFFFFFFFFFFFF, len(self.levels)]
        for x in self.levels:
            head += [x.size, x.sections, x.state, int(round(x.k * 1e6))]
        return np.array(head, np.int64).tobytes() + b"".join(x.values().tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> RelativeSketch:
        n, k, high, coin, count = np.frombuffer(data, np.int64, 5).tolist()
        out = cls(k, bool(high), coin)
        out.n, out.levels = n, []
        meta = np.frombuffer(data, np.int64, 4 * count, 40).reshape(count, 4).tolist()
        at = 40 + 32 * count
        for size, sections, state, ks in meta:
            level = Level(ks / 1e6, sections, state)
            level.add(np.frombuffer(data, np.float64, size, at))
            at += 8 * size
            out.levels.append(level)
        return out


def _runs(col: pa.Array) -> list[tuple[str, int, int]]:
    """Runs of equal keys in a column that is sorted by key."""
    if not len(col):
        return []
    d = col.dictionary_encode()
    codes = d.indices.to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(codes)) + 1
    starts = [0, *cuts.tolist()]
    ends = [*cuts.tolist(), len(codes)]
    names = d.dictionary.to_pylist()
    return [(names[codes[s]], s, e) for s, e in zip(starts, ends)]


def _rows(out: list[tuple[str, RelativeSketch]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in out], pa.string()), pa.array([s.n for _, s in out], pa.int64()), pa.array([s.to_bytes() for _, s in out], pa.binary())], names=["key", "n", "sketch"]
    )


def _fold(k: int, high: bool, merging: bool):
    """One sketch per run of equal keys; one is open at a time, so memory doesn't grow with the keys."""
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sketch, out = None, None, []
        for b in batches:
            values = b.column(1) if merging else b.column(1).to_numpy(zero_copy_only=False)
            for name, s, e in _runs(b.column(0)):
                if sketch is None or name != key:
                    if sketch is not None:
                        out.append((key, sketch))
                    key, sketch = name, RelativeSketch(k, high, zlib.crc32(name.encode()) * 2 + 1)
                if merging:
                    for x in values.slice(s, e - s):
                        sketch.merge(RelativeSketch.from_bytes(x.as_py()))
                else:
                    sketch.add(values[s:e])
                if len(out) >= 500:
                    yield _rows(out)
                    out = []
        if sketch is not None:
            out.append((key, sketch))
        if out:
            yield _rows(out)

    return run


def sketch_partitions(rows: DataFrame, key: str, value: str, k: int = K, high: bool = True) -> DataFrame:
    """Partial sketches (key, n, sketch): one per key and partition of `rows`; this step shuffles nothing.

    Rows whose key or value is null or whose value is NaN are left out.
    """
    v = F.col(value).cast("double")
    clean = rows.select(F.col(key).cast("string").alias("key"), v.alias("value")).where(F.col("key").isNotNull() & v.isNotNull() & ~F.isnan(v))
    return clean.sortWithinPartitions("key").mapInArrow(_fold(k, high, False), f"key string, {SKETCH}")


def merge_sketches(sketches: DataFrame, k: int = K, high: bool = True, salts: int | None = None) -> DataFrame:
    """One sketch per key out of partial ones (key, n, sketch), as of partitions, days or files.

    Two steps: partial sketches of a key are first merged by `salts` tasks, so no task receives all those of a hot key.
    A key has a partial sketch for each partition at most, so by default there are as many salts as the root of the
    shuffle partitions: either step then merges about that many sketches of a key.
    """
    salts = salts or max(8, math.isqrt(int(sketches.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    fold = _fold(k, high, True)
    kind = f"key string, {SKETCH}"
    salted = sketches.select("key", "sketch", F.pmod(F.xxhash64("sketch"), F.lit(salts)).alias("_salt"))
    first = salted.repartition("key", "_salt").select("key", "sketch").sortWithinPartitions("key").mapInArrow(fold, kind)
    return first.select("key", "sketch").repartition("key").sortWithinPartitions("key").mapInArrow(fold, kind)


def read_quantiles(sketches: DataFrame, at: list[float]) -> DataFrame:
    """Quantiles of merged sketches: key, n, q (list in the order of `at`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [RelativeSketch.from_bytes(x.as_py()).quantiles(at) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.float64()))], names=["key", "n", "q"])

    return sketches.select("key", "n", "sketch").mapInArrow(run, "key string, n long, q array<double>")


def label_sketches(readings: DataFrame, labels: DataFrame, k: int = K, high: bool = True) -> DataFrame:
    """Sketches of the readings (series_key, value) of each label value (series_key, label_value).

    Readings become partial sketches by series before they meet the labels, so a label value that covers a third of
    all rows costs a few sketches per series, and no reading is copied once per label. What a partition holds of a label
    value is merged before the shuffle, so one that covers most series costs one sketch per partition.
    """
    from chronoloom.session import sized_join

    parts = sketch_partitions(readings, "series_key", "value", k, high).withColumnRenamed("key", "series_key")
    pairs = labels.select("series_key", F.col("label_value").alias("key")).where(F.col("key").isNotNull() & F.col("series_key").isNotNull()).distinct()
    own = sized_join(parts, pairs, ["series_key"]).select("key", "sketch").sortWithinPartitions("key").mapInArrow(_fold(k, high, True), f"key string, {SKETCH}")
    return merge_sketches(own, k, high)
