"""The data model: a long table of samples beside a catalog of labelled series."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Greatest time tag, the meaning of `+` as the end of a range.
MAX_TS = (1 << 63) - 1
#: Duplicate policies, and bounds and defaults of a series' options.
POLICIES = ("block", "first", "last", "min", "max", "sum")
ENCODINGS = ("compressed", "uncompressed")
DEFAULT_CHUNK, LEAST_CHUNK, MOST_CHUNK = 4096, 48, 1 << 20

CATALOG = (
    "series_key string, labels map<string,string>, retention_ms long, chunk_size long, encoding string, duplicate_policy string, "
    "ignore_max_time_diff long, ignore_max_val_diff double, source_key string"
)
_DEFAULTS = {
    "labels": ("map<string,string>", None),
    "retention_ms": ("long", 0),
    "chunk_size": ("long", DEFAULT_CHUNK),
    "encoding": ("string", "compressed"),
    "duplicate_policy": ("string", None),
    "ignore_max_time_diff": ("long", 0),
    "ignore_max_val_diff": ("double", 0.0),
    "source_key": ("string", None),
}


@dataclass(frozen=True)
class EngineConfig:
    """Module-wide defaults."""

    duplicate_policy: str = "block"
    retention_ms: int = 0
    chunk_size: int = DEFAULT_CHUNK
    encoding: str = "compressed"


@dataclass(frozen=True)
class TimeSeries:
    """`samples` (series_key, ts, value), unique by (series_key, ts); `series`, the catalog; `rules`, downsampling rules."""

    samples: DataFrame
    series: DataFrame
    rules: DataFrame | None = None
    config: EngineConfig = EngineConfig()
    #: Samples of a key (None: all) in [lo, hi], by filters on the columns as they are stored, so that the scan can prune.
    scan: Callable[[str | None, int, int], DataFrame] | None = None

    def with_samples(self, samples: DataFrame) -> TimeSeries:
        return replace(self, samples=samples, scan=None)

    def between(self, lo: int, hi: int, key: str | None = None) -> DataFrame:
        """Samples of [lo, hi], of one series if `key` is given."""
        if self.scan is not None:
            return self.scan(key, lo, hi)
        rows = self.samples.select("series_key", "ts", "value").where(F.col("ts").between(lo, hi))
        return rows if key is None else rows.where(F.col("series_key") == key)

    def of(self, key: str, lo: int = 0, hi: int = MAX_TS) -> TimeSeries:
        """One series only."""
        return replace(self, samples=self.between(lo, hi, key), series=self.series.where(F.col("series_key") == key), scan=None)

    def with_series(self, series: DataFrame) -> TimeSeries:
        return replace(self, series=series)


def catalog(series: DataFrame) -> DataFrame:
    """`series` with all catalog columns; missing columns and null options get their defaults."""
    cols = [F.col("series_key")]
    for name, (kind, default) in _DEFAULTS.items():
        if name in series.columns:
            c = F.col(name).cast(kind) if name != "labels" else F.col(name)
            cols.append((F.coalesce(c, F.lit(default)) if default is not None else c).alias(name))
        else:
            cols.append(F.lit(default).cast(kind).alias(name))
    return series.where(F.col("series_key").isNotNull()).select(*cols)


def check_labels(labels: dict[str, str]) -> None:
    """Label rules: keys and values are not empty, keys have no `=`, values none of `(`, `)` and `,`."""
    for k, v in labels.items():
        if not k or "=" in k:
            raise ValueError(f"bad label name {k!r}")
        if not v or any(c in v for c in "(),"):
            raise ValueError(f"bad value {v!r} of label {k!r}")


def series_row(key: str, labels: dict[str, str] | None = None, retention_ms: int = 0, chunk_size: int = DEFAULT_CHUNK, encoding: str = "compressed",
               duplicate_policy: str | None = None, ignore: tuple[int, float] = (0, 0.0), source_key: str | None = None) -> tuple:
    """A validated row of the catalog."""
    check_labels(labels or {})
    if retention_ms < 0:
        raise ValueError("retention must not be negative")
    if chunk_size % 8 or not LEAST_CHUNK <= chunk_size <= MOST_CHUNK:
        raise ValueError("the chunk size has to be divisible by 8 and lie between 48 and 1048576")
    if encoding.lower() not in ENCODINGS:
        raise ValueError(f"unknown encoding {encoding!r}")
    if duplicate_policy is not None and duplicate_policy.lower() not in POLICIES:
        raise ValueError(f"unknown duplicate policy {duplicate_policy!r}")
    if ignore[0] < 0 or ignore[1] < 0:
        raise ValueError("ignore thresholds must not be negative")
    policy = duplicate_policy.lower() if duplicate_policy else None
    return (key, labels or {}, retention_ms, chunk_size, encoding.lower(), policy, int(ignore[0]), float(ignore[1]), source_key)


def create(ts: TimeSeries, key: str, **options) -> TimeSeries:
    """A new series in the catalog; an error if the key exists."""
    if not ts.series.where(F.col("series_key") == key).isEmpty():
        raise ValueError(f"series {key!r} exists already")
    row = ts.series.sparkSession.createDataFrame([series_row(key, **options)], CATALOG)
    return ts.with_series(catalog(ts.series).unionByName(row))


def alter(ts: TimeSeries, key: str, **options) -> TimeSeries:
    """Changes the named options only; labels replace the whole set; the encoding can't be altered."""
    if "encoding" in options:
        raise ValueError("the encoding can't be altered")
    row = series_row(key, **options)
    names = [x.strip().split(" ")[0] for x in ("series_key", "labels", "retention_ms", "chunk_size", "encoding", "duplicate_policy", "ignore_max_time_diff", "ignore_max_val_diff", "source_key")]
    new = dict(zip(names, row))
    wanted = {"ignore": ("ignore_max_time_diff", "ignore_max_val_diff")}
    hit = F.col("series_key") == key
    series = catalog(ts.series)
    if series.where(hit).isEmpty():
        raise ValueError(f"there is no series {key!r}")
    for option in options:
        for name in wanted.get(option, (option,)):
            v = new[name]
            c = F.create_map(*[F.lit(x) for kv in v.items() for x in kv]) if isinstance(v, dict) and v else F.lit(None).cast("map<string,string>") if isinstance(v, dict) else F.lit(v)
            series = series.withColumn(name, F.when(hit, c).otherwise(F.col(name)))
    return ts.with_series(series)


def copy_series(ts: TimeSeries, key: str, to: str) -> TimeSeries:
    """A copy of a series and its samples under another key; rules are not copied. An error if that key exists."""
    if not ts.series.where(F.col("series_key") == to).isEmpty():
        raise ValueError(f"series {to!r} exists already")
    row = catalog(ts.series).where(F.col("series_key") == key).withColumn("series_key", F.lit(to)).withColumn("source_key", F.lit(None).cast("string"))
    rows = ts.samples.where(F.col("series_key") == key).withColumn("series_key", F.lit(to))
    return replace(ts, scan=None, samples=ts.samples.unionByName(rows), series=catalog(ts.series).unionByName(row))


def rename_series(ts: TimeSeries, key: str, to: str) -> TimeSeries:
    """Another key for a series, in its samples, the catalog and the rules."""
    new = lambda c: F.when(F.col(c) == key, F.lit(to)).otherwise(F.col(c)).alias(c)
    rows = ts.samples.withColumn("series_key", new("series_key"))
    series = catalog(ts.series).withColumn("series_key", new("series_key")).withColumn("source_key", new("source_key"))
    rules = ts.rules.withColumn("source_key", new("source_key")).withColumn("dest_key", new("dest_key")) if ts.rules is not None else None
    return replace(ts, scan=None, samples=rows, series=series, rules=rules)
