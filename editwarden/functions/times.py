"""Time expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT_FORMAT = "dd/MM/yyyy HH:mm"
DAY_SECONDS = 86_400


def time_of_day(ts: Column) -> Column:
    hour = F.hour(ts)
    return (
        F.when((hour >= 5) & (hour < 12), "morning")
        .when((hour >= 12) & (hour < 17), "afternoon")
        .when((hour >= 17) & (hour < 21), "evening")
        .otherwise("night")
    )


def day_of_week(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 as a double."""
    return epoch_micros(ts) / F.lit(1e6)


def text_to_epoch(text: Column, pattern: str = TEXT_FORMAT) -> Column:
    """Seconds since 1970 of a text timestamp; -1 when it is missing or cannot be read."""
    return F.coalesce(epoch_seconds(F.try_to_timestamp(text, F.lit(pattern))), F.lit(-1.0))


def _little_endian(hexed: Column, first_byte: int) -> Column:
    pairs = [F.substring(hexed, 2 * (first_byte + i) + 1, 2) for i in (3, 2, 1, 0)]
    return F.conv(F.concat(*pairs), 16, 10).cast("bigint")


def interval_seconds(raw: Column) -> Column:
    """Seconds in a 12-byte interval of months, days and milliseconds; a month has 30 days.

    Missing or short values give -1."""
    hexed = F.hex(raw)
    seconds = (
        _little_endian(hexed, 0) * F.lit(30 * DAY_SECONDS)
        + _little_endian(hexed, 4) * F.lit(DAY_SECONDS)
        + _little_endian(hexed, 8) / F.lit(1000.0)
    )
    return F.when(F.length(raw) >= 12, seconds).otherwise(F.lit(-1.0))


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def month_from_name(name: Column) -> Column:
    """``YYYY-MM`` standing alone in a file name, else null; digits of a longer word do not count."""
    found = F.regexp_extract(name, r"(?<![0-9A-Za-z])(\d{4}-(?:0[1-9]|1[0-2]))(?![0-9A-Za-z])", 1)
    return F.when(found != "", found)


def in_hours(ts: Column, hours: Column) -> Column:
    """A timestamp moved by a whole number of hours."""
    return in_seconds(ts, hours * F.lit(3600))


def in_seconds(ts: Column, seconds: Column) -> Column:
    zero = F.lit(0)
    return ts + F.make_dt_interval(zero, zero, zero, seconds.cast("decimal(18,6)"))
