"""Strings of default downsampling policies."""

from __future__ import annotations

import re
from dataclasses import dataclass

from chronoloom.functions.aggregates import parse_names

#: Milliseconds of the duration letters.
UNITS = {"m": 1, "s": 1000, "M": 60_000, "h": 3_600_000, "d": 86_400_000}
_DURATION = re.compile(r"(\d+)([msMhd])")


@dataclass(frozen=True)
class Policy:
    agg: str
    bucket_ms: int
    retention_ms: int
    align_ms: int = 0

    def dest_key(self, key: str) -> str:
        """Key of the destination that the policy creates for a series."""
        end = f"_{self.align_ms}" if self.align_ms else ""
        return f"{key}_{self.agg.upper()}_{self.bucket_ms}{end}"

    def labels(self, labels: dict[str, str]) -> dict[str, str]:
        """Labels of the destination."""
        return {**labels, "aggregation": self.agg, "time_bucket": str(self.bucket_ms)}


def duration_ms(text: str) -> int:
    """Milliseconds of `10s`, `5M` and the like; 0 may have any unit."""
    m = _DURATION.fullmatch(text.strip())
    if not m:
        raise ValueError(f"bad duration {text!r}")
    return int(m[1]) * UNITS[m[2]]


def parse_policies(text: str) -> list[Policy]:
    """Policies of `agg:bucket:retention[:align];…`."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(";"))):
        fields = part.split(":")
        if len(fields) not in (3, 4):
            raise ValueError(f"bad policy {part!r}")
        names = parse_names(fields[0])
        if len(names) != 1:
            raise ValueError(f"bad policy {part!r}")
        p = Policy(names[0], *map(duration_ms, fields[1:]))
        if p.bucket_ms <= 0:
            raise ValueError(f"bad bucket in policy {part!r}")
        out.append(p)
    return out
