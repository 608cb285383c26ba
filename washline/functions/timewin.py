"""Report time windows as half-open timestamp ranges.

"Today", "This Month" and "This Year" are calendar ranges; "Last 7 Days" starts at
midnight seven days before ``as_of`` and has no upper bound (eight calendar dates
and any later rows count). Written as ranges on the raw column, not as
``month(c) = m``, so Catalyst pushes them into the parquet scan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOWS = ("Today", "Last 7 Days", "This Month", "This Year", "All Time")


def _as_date(as_of) -> dt.date:
    if isinstance(as_of, dt.datetime):
        return as_of.date()
    if isinstance(as_of, dt.date):
        return as_of
    return dt.date.fromisoformat(str(as_of))


def bounds(name: str, as_of) -> tuple[dt.datetime | None, dt.datetime | None]:
    """(inclusive lower, exclusive upper) bound; None means open."""
    d = _as_date(as_of)
    start = dt.datetime(d.year, d.month, d.day)
    if name == "Today":
        return start, start + dt.timedelta(days=1)
    if name == "Last 7 Days":
        return start - dt.timedelta(days=7), None
    if name == "This Month":
        lo = dt.datetime(d.year, d.month, 1)
        hi = dt.datetime(d.year + (d.month == 12), d.month % 12 + 1, 1)
        return lo, hi
    if name == "This Year":
        return dt.datetime(d.year, 1, 1), dt.datetime(d.year + 1, 1, 1)
    if name == "All Time":
        return None, None
    raise ValueError(f"unknown time window {name!r}; expected one of {WINDOWS}")


def ts_lit(value: dt.datetime) -> Column:
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def in_window(col: str | Column, name: str, as_of) -> Column:
    """Predicate for ``col`` inside window ``name`` at ``as_of`` (NULL never matches)."""
    c = F.col(col) if isinstance(col, str) else col
    lo, hi = bounds(name, as_of)
    pred = F.lit(True)
    if lo is not None:
        pred = c >= ts_lit(lo)
    if hi is not None:
        pred = pred & (c < ts_lit(hi))
    return pred


def sql_in_window(col: str, name: str, as_of) -> str:
    """The same predicate as SQL text (used by the DuckDB oracle)."""
    lo, hi = bounds(name, as_of)
    parts = []
    if lo is not None:
        parts.append(f"{col} >= TIMESTAMP '{lo:%Y-%m-%d %H:%M:%S}'")
    if hi is not None:
        parts.append(f"{col} < TIMESTAMP '{hi:%Y-%m-%d %H:%M:%S}'")
    return " AND ".join(parts) if parts else "TRUE"
