"""Array (higher-order function) helpers on small per-row arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value, body) -> Column:
    """``body(value)`` with ``value`` computed once for the row, however often
    ``body`` names it and in whatever lambda."""
    return F.aggregate(F.array(F.lit(0)), _col(value), lambda acc, _: acc, body)


def greedy_spans(spans) -> Column:
    """Non-overlapping spans: longest first, then leftmost (``[start, end)``).

    ``spans`` is an ``array<struct<start, end, …>>`` of one text; the result is
    sorted by ``start``.  Used for mention overlaps (J7) and span merging (T11).
    """
    s = _col(spans)
    ordered = F.array_sort(s, lambda a, b: (
        F.when((a["end"] - a["start"]) > (b["end"] - b["start"]), -1)
        .when((a["end"] - a["start"]) < (b["end"] - b["start"]), 1)
        .when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
        .otherwise(0)))
    empty = F.filter(s, lambda x: F.lit(False))
    picked = F.aggregate(ordered, empty, lambda acc, x: F.when(
        F.exists(acc, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])),
        acc).otherwise(F.concat(acc, F.array(x))))
    return F.array_sort(picked, lambda a, b: F.when(a["start"] < b["start"], -1)
                        .when(a["start"] > b["start"], 1).otherwise(0))


def l2_normalize(vec) -> Column:
    """M6: scale an ``array<double>`` to unit length; a zero row is unchanged."""
    v = _col(vec)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda acc, x: acc + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)
