"""Time expressions. Buckets are whole microseconds since the epoch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def micros(at: Column) -> Column:
    return F.unix_micros(at)


def bucket_start(at: Column, width_us: int) -> Column:
    """Start of the bucket of `width_us` that holds `at`, as a timestamp."""
    us = F.unix_micros(at)
    return F.timestamp_micros(us - F.pmod(us, F.lit(width_us)))


def gap_us(later: Column, earlier: Column) -> Column:
    return F.unix_micros(later) - F.unix_micros(earlier)


def local(at: Column, zone: str) -> Column:
    return F.from_utc_timestamp(at, zone)


def year_month(at: Column, zone: str) -> Column:
    return F.date_format(local(at, zone), "yyyyMM")


def iso_text(at: Column, zone: str = "Asia/Seoul", offset: str = "+09:00") -> Column:
    """ISO-8601 text with microseconds and a fixed offset."""
    return F.concat(F.date_format(local(at, zone), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(offset))


def due_at() -> Column:
    """When a request should leave: its schedule, else its arrival."""
    return F.coalesce(F.col("scheduled_at"), F.col("requested_at"))
