"""The fifteen bucket aggregators as column expressions.

`v` stands for the value where it is a number and null where it is NaN, so that Spark's aggregates skip NaN. An
aggregator that accepted no value gives its empty value: 0 for sum and the counts, NaN for the others.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The names of the aggregators.
NAMES = ("min", "max", "sum", "avg", "count", "first", "last", "range", "std.p", "std.s", "var.p", "var.s", "twa", "countnan", "countall")
#: Aggregators that may reduce across series.
REDUCERS = tuple(n for n in NAMES if n not in ("first", "last", "twa"))
#: Aggregators whose empty value is 0.
ZERO = ("sum", "count", "countnan", "countall")
#: Most aggregators in one request.
MOST = 16


def parse_names(spec: str | list[str] | tuple[str, ...]) -> list[str]:
    """Names of a comma-separated list, in any case; duplicates are allowed."""
    names = [x.strip().lower() for x in (spec.split(",") if isinstance(spec, str) else spec)]
    if not names or any(n not in NAMES for n in names):
        raise ValueError(f"unknown aggregation type in {spec!r}")
    if len(names) > MOST:
        raise ValueError(f"more than {MOST} aggregators")
    return names


def column_name(name: str, i: int | None = None) -> str:
    """A plain column name of an aggregator."""
    base = name.replace(".", "_")
    return base if i is None else f"{base}_{i}"


def number(value: Column) -> Column:
    """The value where it is a number, else null."""
    return F.when(~F.isnan(value), value)


def aggregate(name: str, value: Column, ts: Column) -> Column:
    """One aggregator over rows (ts, value) as an aggregate expression; null where it accepted nothing (0 for counts)."""
    v = number(value)
    match name:
        case "min":
            return F.min(v)
        case "max":
            return F.max(v)
        case "sum":
            return F.sum(v)
        case "avg":
            return F.avg(v)
        case "count":
            return F.count(v).cast("double")
        case "first":
            return F.min_by(v, F.when(v.isNotNull(), ts))
        case "last":
            return F.max_by(v, F.when(v.isNotNull(), ts))
        case "range":
            return F.max(v) - F.min(v)
        case "std.p":
            return F.stddev_pop(v)
        case "var.p":
            return F.var_pop(v)
        case "std.s":
            return F.when(F.count(v) == 1, 0.0).otherwise(F.stddev_samp(v))
        case "var.s":
            return F.when(F.count(v) == 1, 0.0).otherwise(F.var_samp(v))
        case "countnan":
            return F.count_if(F.isnan(value)).cast("double")
        case "countall":
            return F.count(value).cast("double")
    raise ValueError(f"{name} is not a plain aggregate")


def accepted(names: list[str], value: Column) -> Column:
    """Aggregate condition: any of the aggregators accepted a sample."""
    if "countall" in names or ("countnan" in names and any(n != "countnan" for n in names)):
        return F.count(value) > 0
    if "countnan" in names:
        return F.count_if(F.isnan(value)) > 0
    return F.count(number(value)) > 0


def filled(name: str, col: Column) -> Column:
    """`col` with the aggregator's empty value in place of null."""
    return F.coalesce(col, F.lit(0.0 if name in ZERO else float("nan")))
