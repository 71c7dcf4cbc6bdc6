"""Time arithmetic on UTC timestamps, with or without a zone."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds since the epoch; the session zone must be UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from start to end, rounded down."""
    return F.floor((micros(end) - micros(start)) / F.lit(1_000_000)).cast("bigint")


def instant(text: str) -> Column:
    """A zone-free UTC timestamp literal, cut to seconds like the as-of clock."""
    at = datetime.fromisoformat(text)
    if at.tzinfo is not None:
        at = at.astimezone(timezone.utc)
    return F.lit(at.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def iso_utc(ts: Column) -> Column:
    """ISO text with second precision and a Z."""
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_iso(text: Column) -> Column:
    """Zone-free timestamp, or null for text that is not a whole ISO date, with or without a time."""
    whole = text.rlike(
        r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
    )
    return F.when(whole, text.try_cast("timestamp").cast("timestamp_ntz"))
