"""Clock arithmetic. "Now" is always an argument, never the wall clock of a task."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitetide.functions.text import as_col

BUSINESS_OFFSET = "+08:00"
STALE_AFTER = "6 HOURS"
RECENT_WINDOW = "7 DAYS"


def moment(as_of: datetime | str | Column) -> Column:
    """An instant given as datetime, ISO text or column."""
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, datetime):
        aware = as_of if as_of.tzinfo else as_of.replace(tzinfo=timezone.utc)
        as_of = aware.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    return F.lit(as_of).cast("timestamp")


def shanghai_day_start(ts: Column | str) -> Column:
    """UTC instant at which the business day (fixed UTC+8) of ``ts`` began."""
    local = F.from_utc_timestamp(as_col(ts), BUSINESS_OFFSET)
    return F.to_utc_timestamp(F.date_trunc("day", local), BUSINESS_OFFSET)


def utc_day_start(ts: Column | str) -> Column:
    return F.date_trunc("day", as_col(ts))


def ago(ts: Column | str, interval: str) -> Column:
    return as_col(ts) - F.expr(f"INTERVAL {interval}")


def iso_utc(ts: Column | str) -> Column:
    return F.date_format(as_col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
