"""Calendar and clock arithmetic on epoch seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local(at: Column, zone: str) -> Column:
    """Wall-clock timestamp in a zone, daylight saving included."""
    return F.from_utc_timestamp(F.timestamp_seconds(at), zone)


def local_day(at: Column, zone: str) -> Column:
    return F.to_date(local(at, zone))


def fixed_day(at: Column, hours: int = 3) -> Column:
    return F.to_date(F.timestamp_seconds(at + hours * 3600))


def night_day(at: Column, hours: int = 3, night: int = 5) -> Column:
    """The small hours belong to the day before."""
    return F.to_date(F.timestamp_seconds(at + (hours - night) * 3600))


def window_start(at: Column, every_hours: int, offset_hours: int = 3) -> Column:
    """Start of the tumbling window of local clock hours."""
    step = every_hours * 3600
    return F.floor((at + offset_hours * 3600) / step) * step - offset_hours * 3600


def is_mark(at: Column, every_hours: int = 6, offset_hours: int = 3) -> Column:
    return F.pmod(F.floor((at + offset_hours * 3600) / 3600), F.lit(24)) % every_hours == 0


def due(now: Column, last: Column, every_minutes: Column) -> Column:
    return last.isNull() | (now - last >= every_minutes * 60)


def near_year(month: Column, day: Column, hour: Column, now: Column) -> Column:
    """Epoch seconds of a date without a year: the one from 60 days before now to 300 days after."""
    year = F.year(F.timestamp_seconds(now))
    tries = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.unix_seconds(F.try_make_timestamp(year + k, month, day, hour, F.lit(0), F.lit(0))))
    return F.get(F.filter(tries, lambda t: t.between(now - 60 * 86400, now + 300 * 86400)), F.lit(0))


#: Days of the Persian calendar's count at 1970-01-01 (fixed value of the 33-year rule).
_PERSIAN_EPOCH = 1075195


def persian(day: Column) -> Column:
    """(y, m, d) of the Persian calendar by its 33-year rule."""
    n = F.unix_date(day) + _PERSIAN_EPOCH
    r = n % 12053
    q = r % 1461
    late = q > 365
    y = -1595 + 33 * F.floor(n / 12053) + 4 * F.floor(r / 1461) + F.when(late, F.floor((q - 1) / 365)).otherwise(0)
    k = F.when(late, (q - 1) % 365).otherwise(q)
    m = F.when(k < 186, 1 + F.floor(k / 31)).otherwise(7 + F.floor((k - 186) / 30))
    d = F.when(k < 186, 1 + k % 31).otherwise(1 + (k - 186) % 30)
    return F.struct(y.cast("int").alias("y"), m.cast("int").alias("m"), d.cast("int").alias("d"))


def from_persian(y: Column, m: Column, d: Column) -> Column:
    """The date of a day of the Persian calendar."""
    k = y + 1595
    days = -355668 + 365 * k + F.floor(k / 33) * 8 + F.floor((k % 33 + 3) / 4) + d + F.when(m < 7, (m - 1) * 31).otherwise((m - 7) * 30 + 186)
    return F.date_from_unix_date((days - (_PERSIAN_EPOCH - 355667)).cast("int"))
