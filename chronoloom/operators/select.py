"""Selection of series by label matchers, and listings of labels."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labels that a query may ask for by name.
MOST_SELECTED = 50


@dataclass(frozen=True)
class Matcher:
    """`values` None: the label is missing (or, negated, present); else it is one of them (or, negated, none or missing)."""

    label: str
    values: tuple[str, ...] | None
    negated: bool = False

    @property
    def positive(self) -> bool:
        return self.values is not None and not self.negated

    def condition(self) -> Column:
        held = F.col("labels").getItem(self.label)
        if self.values is None:
            return held.isNotNull() if self.negated else held.isNull()
        hit = F.coalesce(held.isin(*self.values), F.lit(False)) if self.values else F.lit(False)
        return ~hit if self.negated else hit


def parse_matcher(text: str) -> Matcher:
    """`l=v`, `l!=v`, `l=`, `l!=`, `l=(a,b)` and `l!=(a,b)`; the text is split once, at its first `=`."""
    label, eq, value = text.partition("=")
    negated = label.endswith("!")
    label = label[:-1] if negated else label
    if not eq or not label:
        raise ValueError(f"failed to parse matcher {text!r}")
    if not value:
        return Matcher(label, None, negated)
    if value.startswith("("):
        if not value.endswith(")"):
            raise ValueError(f"failed to parse matcher {text!r}")
        return Matcher(label, tuple(x.strip() for x in value[1:-1].split(",") if x.strip()), negated)
    return Matcher(label, (value,), negated)


def parse_filter(filters: list[str] | tuple[str, ...]) -> list[Matcher]:
    """All matchers must hold; one at least must name wanted values."""
    out = [parse_matcher(f) for f in filters]
    if not any(m.positive for m in out):
        raise ValueError("a filter needs a matcher that names wanted values")
    return out


def select_series(series: DataFrame, filters: list[str] | tuple[str, ...]) -> DataFrame:
    """Catalog rows whose labels satisfy all matchers."""
    return series.where(reduce(and_, [m.condition() for m in parse_filter(filters)]))


def query_index(series: DataFrame, filters: list[str]) -> DataFrame:
    """Keys of the selected series."""
    return select_series(series, filters).select("series_key").distinct()


def label_names(series: DataFrame, filters: list[str] | None = None) -> DataFrame:
    """Distinct label names of the selected series, of all labelled ones without a filter."""
    rows = select_series(series, filters) if filters else series
    return rows.select(F.explode(F.map_keys("labels")).alias("label")).distinct()


def label_values(series: DataFrame, label: str, filters: list[str] | None = None) -> DataFrame:
    """Distinct values of one label."""
    rows = select_series(series, filters) if filters else series
    return rows.select(F.col("labels").getItem(label).alias("value")).where(F.col("value").isNotNull()).distinct()


def selected_labels(names: list[str]) -> Column:
    """The named labels as a map, null where a series has none; the match of names ignores case."""
    if not names or len(names) > MOST_SELECTED:
        raise ValueError(f"between 1 and {MOST_SELECTED} labels can be selected")
    none = F.create_map().cast("map<string,string>")
    entries = F.map_entries(F.coalesce("labels", none))

    def held(name: str) -> Column:
        return F.try_element_at(F.filter(entries, lambda e: F.lower(e["key"]) == name.lower()), F.lit(1))["value"]

    return F.create_map(*[c for n in dict.fromkeys(names) for c in (F.lit(n), held(n))])
