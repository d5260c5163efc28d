"""Time text, calendar parts and exact durations (column expressions only).

Canonical time is a wall clock without zone (``TIMESTAMP_NTZ``); nothing here
converts between zones.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    EXPORT_FORMAT, EXPORT_PATTERN, EXPORT_PATTERN_STRICT, ISO_SECONDS_FORMAT,
)


def parse_export_time(c: Column, strict: bool = False) -> Column:
    """``Aug 12, 2025 @ 16:03:14.261`` to a wall clock, anything else to NULL.

    The fraction is optional unless ``strict``.
    """
    pattern = EXPORT_PATTERN_STRICT if strict else EXPORT_PATTERN
    return F.try_to_timestamp(F.trim(c), F.lit(pattern)).cast("timestamp_ntz")


def parse_any_time(c: Column) -> Column:
    """Export-format text first, ISO text second, otherwise NULL."""
    return F.coalesce(parse_export_time(c), c.try_cast("timestamp_ntz"))


def format_export_time(c: Column) -> Column:
    """Back to export text, cut to milliseconds; NULL becomes the empty string."""
    return F.coalesce(F.date_format(c, EXPORT_FORMAT), F.lit(""))


def format_iso_seconds(c: Column) -> Column:
    return F.date_format(c, ISO_SECONDS_FORMAT)


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a wall clock, independent of the session zone."""
    seconds = F.unix_date(c.cast("date")).cast("long") * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    fraction = F.pmod(F.unix_micros(c.cast("timestamp")), F.lit(1_000_000))
    return seconds * 1_000_000 + fraction


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def hour_or_zero(ts: Column) -> Column:
    return F.coalesce(F.hour(ts), F.lit(0))


def off_hours_flag(hour: Column) -> Column:
    """1 from 00:00 to 06:59."""
    return hour.between(0, 6).cast("int")


def hour_bucket(hour: Column, width_hours: int = 2) -> Column:
    return (F.floor(hour / width_hours) * width_hours).cast("int")


def calendar_features(ts: Column, minute_bucket_s: int = 60, hour_bucket_h: int = 2) -> dict[str, Column]:
    """Seven calendar features; a missing time counts as Monday 00:00:00."""
    hour = hour_or_zero(ts)
    dow = F.coalesce(F.weekday(ts), F.lit(0))
    second = F.coalesce(F.minute(ts) * 60 + F.second(ts), F.lit(0))
    return {
        "hour_local": hour,
        "is_off_hours": off_hours_flag(hour),
        "day_of_week": dow,
        "is_weekend": (dow >= 5).cast("int"),
        "second_in_hour": second,
        "seconds_in_hour_bucketed": F.floor(second / minute_bucket_s).cast("int"),
        "hour_bucket": hour_bucket(hour, hour_bucket_h),
    }


def with_clock(ts: Column, hour: Column, minute: Column, second: Column, milli: Column) -> Column:
    """Same date, new time of day."""
    return F.make_timestamp_ntz(
        F.year(ts), F.month(ts), F.dayofmonth(ts), hour, minute, second + milli / F.lit(1000.0)
    )
