"""The aggregators over the samples of one bucket in memory, for stateful streams."""

from __future__ import annotations

import numpy as np


def aggregate_array(name: str, ts: np.ndarray, values: np.ndarray) -> float | None:
    """Aggregator `name` over samples sorted by ts; None where it accepted none. Only `twa` needs neighbours and is not among them."""
    real = ~np.isnan(values)
    if name == "countall":
        return float(len(values)) if len(values) else None
    if name == "countnan":
        return float((~real).sum()) if (~real).any() else None
    v = values[real]
    if not len(v):
        return None
    match name:
        case "min":
            return float(v.min())
        case "max":
            return float(v.max())
        case "sum":
            return float(v.sum())
        case "avg":
            return float(v.mean())
        case "count":
            return float(len(v))
        case "first":
            return float(v[0])
        case "last":
            return float(v[-1])
        case "range":
            return float(v.max() - v.min())
        case "std.p":
            return float(v.std())
        case "var.p":
            return float(v.var())
        case "std.s":
            return float(v.std(ddof=1)) if len(v) > 1 else 0.0
        case "var.s":
            return float(v.var(ddof=1)) if len(v) > 1 else 0.0
    raise ValueError(f"{name!r} needs neighbours or is unknown")
