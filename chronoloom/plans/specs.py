"""Validated requests."""

from __future__ import annotations

from dataclasses import dataclass, field

from chronoloom.functions.aggregates import REDUCERS, parse_names
from chronoloom.model import MAX_TS

#: Most time tags of one filter.
MOST_TIMES = 128
#: The ways to label a bucket.
LABELS = {"start": "start", "-": "start", "mid": "mid", "~": "mid", "end": "end", "+": "end"}


@dataclass(frozen=True)
class Buckets:
    """Aggregation into buckets of `width` ms; `align` is a time tag, "start" or "end"."""

    names: tuple[str, ...]
    width: int
    align: int | str = 0
    label: str = "start"
    empty: bool = False

    def __post_init__(self) -> None:
        object.__setattr__(self, "names", tuple(parse_names(self.names)))
        if self.width <= 0:
            raise ValueError("the bucket duration must be greater than zero")
        if self.label not in LABELS:
            raise ValueError(f"unknown bucket label {self.label!r}")
        object.__setattr__(self, "label", LABELS[self.label])
        a = self.align
        if isinstance(a, str):
            if a not in ("start", "-", "end", "+"):
                raise ValueError(f"unknown alignment {a!r}")
            object.__setattr__(self, "align", "start" if a in ("start", "-") else "end")
        elif a < 0:
            raise ValueError("the alignment must not be negative")


@dataclass(frozen=True)
class RangeSpec:
    """A range [lo, hi] with filters, aggregation, row limit per series and direction."""

    lo: int | None = None
    hi: int | None = None
    times: tuple[int, ...] | None = None
    values: tuple[float, float] | None = None
    buckets: Buckets | None = None
    count: int | None = None
    reverse: bool = False
    latest: bool = False
    retention: bool = True

    def __post_init__(self) -> None:
        if self.count is not None and self.count < 1:
            raise ValueError("count must be positive")
        if any(x is not None and x < 0 for x in (self.lo, self.hi)):
            raise ValueError("time tags must not be negative")
        if self.times is not None:
            if len(self.times) > MOST_TIMES:
                raise ValueError(f"more than {MOST_TIMES} time tags in one filter")
            object.__setattr__(self, "times", tuple(sorted(set(self.times))))
        b = self.buckets
        if b and b.align == "start" and self.lo is None:
            raise ValueError("start alignment needs an explicit start of the range")
        if b and b.align == "end" and self.hi is None:
            raise ValueError("end alignment needs an explicit end of the range")

    @property
    def start(self) -> int:
        return 0 if self.lo is None else self.lo

    @property
    def end(self) -> int:
        return MAX_TS if self.hi is None else self.hi

    @property
    def align(self) -> int:
        a = self.buckets.align if self.buckets else 0
        return self.start if a == "start" else self.end if a == "end" else a


@dataclass(frozen=True)
class MultiRangeSpec:
    """A range over all series that a filter selects, reduced by a label if `group_by` is given."""

    filters: tuple[str, ...]
    range: RangeSpec = field(default_factory=RangeSpec)
    with_labels: bool = False
    selected_labels: tuple[str, ...] = ()
    group_by: str | None = None
    reduce: str | None = None
    exclude_empty: bool = False

    def __post_init__(self) -> None:
        if self.with_labels and self.selected_labels:
            raise ValueError("all labels or selected ones, not both")
        if (self.group_by is None) != (self.reduce is None):
            raise ValueError("grouping needs a label and a reducer")
        if self.group_by is not None:
            object.__setattr__(self, "reduce", self.reduce.lower())
            if self.reduce not in REDUCERS:
                raise ValueError(f"{self.reduce!r} can't reduce across series")
            if self.range.buckets and len(self.range.buckets.names) > 1:
                raise ValueError("several aggregators can't be grouped")
            if self.exclude_empty:
                raise ValueError("empty series can't be excluded from groups")
