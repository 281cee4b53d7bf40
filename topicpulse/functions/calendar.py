"""Calendar helpers: look-back cutoffs, range bounds, ISO rendering.

All arithmetic is UTC (the session time zone is pinned to UTC).
"""

from __future__ import annotations

import calendar
import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Look-back presets (sync re-sends 48 h, backfill 30 days).
SYNC_LOOKBACK = _dt.timedelta(hours=48)
BACKFILL_LOOKBACK = _dt.timedelta(days=30)

# Allowed ranges per window type, and the default range.
VALID_RANGES = {
    "1d": ("this_week", "this_month", "3m"),
    "1w": ("this_month", "3m", "6m"),
    "1m": ("3m", "6m", "12m"),
}
DEFAULT_RANGE = {"1d": "this_week", "1w": "this_month", "1m": "12m"}

# Months subtracted from the current month start per range.
RANGE_MONTHS_BACK = {"3m": 2, "6m": 5, "12m": 11}

# Flat bucket length used for a bucket's ``end``.
BUCKET_DAYS = {"1d": 1, "1w": 7, "1m": 30}


def cutoff(as_of: _dt.datetime, preset: str) -> _dt.datetime:
    """sync = as_of - 48 h, backfill = as_of - 30 d."""
    if preset == "sync":
        return as_of - SYNC_LOOKBACK
    if preset == "backfill":
        return as_of - BACKFILL_LOOKBACK
    raise ValueError(f"unknown look-back preset {preset!r}")


def valid_ranges(window_type: str) -> tuple[str, ...]:
    """Ranges offered for a window type."""
    if window_type not in VALID_RANGES:
        raise ValueError(f"unknown window type {window_type!r}")
    return VALID_RANGES[window_type]


def resolve_range(window_type: str, range_name: str | None) -> str:
    """Keep a valid range, else fall back to the window's default."""
    if range_name in valid_ranges(window_type):
        return range_name
    return DEFAULT_RANGE[window_type]


def _month_start(d: _dt.datetime) -> _dt.datetime:
    return d.replace(day=1, hour=0, minute=0, second=0, microsecond=0)


def _add_months(d: _dt.datetime, n: int) -> _dt.datetime:
    """``d`` moved by n months; a day beyond the month's end becomes its last day."""
    m = d.month - 1 + n
    y = d.year + m // 12
    m = m % 12 + 1
    return d.replace(year=y, month=m, day=min(d.day, calendar.monthrange(y, m)[1]))


def range_bounds(range_name: str, as_of: _dt.datetime) -> tuple[_dt.datetime, _dt.datetime]:
    """R1 + R2: (range start, exclusive range end) for a named range.

    The inclusive end of the reference is "end of unit" (…23:59:59.999);
    the exclusive bound returned here is the start of the next unit.
    """
    day0 = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    if range_name == "this_week":
        start = day0 - _dt.timedelta(days=day0.weekday())
        return start, start + _dt.timedelta(days=7)
    month0 = _month_start(as_of)
    next_month = _add_months(month0, 1)
    if range_name == "this_month":
        return month0, next_month
    if range_name in RANGE_MONTHS_BACK:
        return _add_months(month0, -RANGE_MONTHS_BACK[range_name]), next_month
    # Fallback: today only.
    return day0, day0 + _dt.timedelta(days=1)


def ts_lit(d: _dt.datetime) -> Column:
    """Timestamp literal pinned to UTC.

    A naive ``datetime`` passed to ``F.lit`` is converted with the Python
    driver's local zone; naive values here always mean UTC, so they are
    tagged before conversion and the plan is the same on any driver host.
    """
    if d.tzinfo is None:
        d = d.replace(tzinfo=_dt.timezone.utc)
    return F.lit(d)


def iso_utc(c: Column) -> Column:
    """Render a timestamp the way ``Date.toISOString`` does."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
