"""Instants: literal ``as_of`` handling and epoch conversions."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, functions as F


MICROS_PER_SECOND = 1_000_000
MICROS_PER_HOUR = 3_600 * MICROS_PER_SECOND
MICROS_PER_DAY = 24 * MICROS_PER_HOUR


def to_micros(value) -> int:
    """Epoch microseconds of ``value``.

    ``datetime`` (naive means UTC), ISO-8601 ``str``, or ``int`` epoch
    **seconds** (the API's unit).
    """
    if isinstance(value, bool):
        raise TypeError("as_of must be a datetime, ISO string or epoch seconds")
    if isinstance(value, int):
        return value * MICROS_PER_SECOND
    if isinstance(value, str):
        value = datetime.fromisoformat(value.replace("Z", "+00:00"))
    if isinstance(value, datetime):
        if value.tzinfo is None:
            value = value.replace(tzinfo=timezone.utc)
        delta = value - datetime(1970, 1, 1, tzinfo=timezone.utc)
        return (delta.days * 86_400 + delta.seconds) * MICROS_PER_SECOND + delta.microseconds
    raise TypeError(f"unsupported instant: {value!r}")


def instant(value) -> Column:
    """A TimestampType literal (or pass a Column through)."""
    if isinstance(value, Column):
        return value
    return F.timestamp_micros(F.lit(to_micros(value)))


def instant_sql(value) -> str | None:
    """SQL text of a literal instant, or None when ``value`` is a Column."""
    if isinstance(value, Column):
        return None
    return f"timestamp_micros({to_micros(value)})"


def minus_hours(value, hours: float) -> Column:
    if isinstance(value, Column):
        return F.timestamp_micros(F.unix_micros(value) - F.lit(int(hours * MICROS_PER_HOUR)))
    return F.timestamp_micros(F.lit(to_micros(value) - int(hours * MICROS_PER_HOUR)))


def epoch_s(col) -> Column:
    """Whole epoch seconds, floored (Java ``Instant.getEpochSecond``)."""
    return F.unix_seconds(_c(col))


def epoch_us(col) -> Column:
    return F.unix_micros(_c(col))


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col
