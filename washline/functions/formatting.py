"""Scalar helpers: money and date text, whitespace strip, enum ordinals.

All are built-in expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from washline.sources.schemas import CURRENCY


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def money(col: str | Column) -> Column:
    """'₱1,234.50': thousands separator, two decimals."""
    return F.concat(F.lit(CURRENCY), F.format_number(_c(col), 2))


def money_plain(col: str | Column) -> Column:
    """'₱1234.50': two decimals, no separator (catalog and edit lists)."""
    return F.format_string(CURRENCY + "%.2f", _c(col).cast("double"))


def datetime_text(col: str | Column, na: str | None = None) -> Column:
    """'yyyy-MM-dd HH:mm'; NULL becomes ``na`` when given."""
    txt = F.date_format(_c(col), "yyyy-MM-dd HH:mm")
    return F.coalesce(txt, F.lit(na)) if na is not None else txt


def day_label(col: str | Column) -> Column:
    """'Oct 15' (month abbreviation and day, no year)."""
    return F.date_format(_c(col), "MMM dd")


def strip(col: str | Column) -> Column:
    """Remove leading and trailing whitespace of any kind, Unicode blanks included."""
    return F.regexp_replace(_c(col), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def is_blank(col: str | Column) -> Column:
    """NULL, empty, or whitespace only."""
    return F.coalesce(F.length(strip(col)) == 0, F.lit(True))


def enum_ordinal(col: str | Column, domain: list[str]) -> Column:
    """1-based position of the value in its declared domain (0 when outside, NULL stays NULL)."""
    arr = F.array(*[F.lit(v) for v in domain])
    c = _c(col)
    return F.when(c.isNotNull(), F.array_position(arr, c))


# Wall-clock timestamps (timestamp_ntz) <-> instants, read as UTC whatever the
# session time zone is, so day windows and epoch seconds never shift.
_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def ntz_epoch_seconds(col: str) -> Column:
    return F.expr(f"timestampdiff(SECOND, {_EPOCH}, {col})")


def ntz_to_instant(col: str) -> Column:
    return F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, {_EPOCH}, {col}))")


def instant_to_ntz(col: str) -> Column:
    return F.expr(f"timestampadd(MICROSECOND, unix_micros({col}), {_EPOCH})")
