"""Time rules: second precision, the configured zone, calendar weeks.

All of it expects a session in UTC, where TIMESTAMP and TIMESTAMP_NTZ hold the same clock reading.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailframe import fixed
from mailframe.functions.text import _col


def utc_second(c: Column | str) -> Column:
    """Cut the fraction of a second; keeps TIMESTAMP and TIMESTAMP_NTZ as they are."""
    c = _col(c)
    return c - (c - F.date_trunc("second", c))


def received_at(sent_at: Column | str, processed_at: Column | str) -> Column:
    """The header date where there is one, else the time of processing."""
    return utc_second(F.coalesce(_col(sent_at), _col(processed_at)))


def to_local(c: Column | str, zone: str) -> Column:
    """UTC to the wall clock of ``zone``."""
    return F.from_utc_timestamp(_col(c), zone).cast("timestamp_ntz")


def to_utc(c: Column | str, zone: str) -> Column:
    """The wall clock of ``zone`` to UTC."""
    return F.to_utc_timestamp(_col(c), zone).cast("timestamp_ntz")


def _interval(days: int = 0, hours: int = 0) -> Column:
    return F.make_dt_interval(F.lit(days), F.lit(hours))


def days_before(c: Column | str, zone: str, days: int = fixed.DIGEST_DAYS) -> Column:
    """The same local time ``days`` calendar days earlier, across clock changes."""
    return to_utc(to_local(c, zone) - _interval(days=days), zone)


def week_start(
    c: Column | str, zone: str = fixed.DEFAULT_ZONE, hour: int = fixed.DIGEST_HOUR
) -> Column:
    """Start (UTC) of the local week, Monday at ``hour``, that holds ``c``."""
    local = to_local(c, zone) - _interval(hours=hour)
    monday = F.date_trunc("week", local).cast("timestamp_ntz")
    return to_utc(monday + _interval(hours=hour), zone)


def next_week_start(
    c: Column | str, zone: str = fixed.DEFAULT_ZONE, hour: int = fixed.DIGEST_HOUR
) -> Column:
    """The scheduled run (UTC) at which the week that holds ``c`` ends."""
    local = to_local(week_start(c, zone, hour), zone) + _interval(days=fixed.DIGEST_DAYS)
    return to_utc(local, zone)
