"""Time arithmetic on ``TIMESTAMP_NTZ`` columns that hold UTC.

Durations are computed on the UTC columns, calendar rules on the local wall
clock given by :func:`local`.  Nothing here reads the session time zone:
functions that would (``date_trunc``, ``date_format``, ``timestampdiff`` on
NTZ input) are avoided on purpose.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from deskgauge.constants import LOCAL_ZONE

DEFAULT_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
_MINUTES_PER_DAY = 1440


def moment(value: dt.datetime | str | None = None) -> Column:
    """Literal UTC instant; ``None`` is the current time, read once here."""
    if value is None:
        value = dt.datetime.now(dt.timezone.utc)
    if isinstance(value, dt.datetime):
        if value.tzinfo is not None:
            value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
        value = value.isoformat(sep=" ")
    return F.lit(value).cast("timestamp_ntz")


def _instant_to_utc(instant: Column) -> Column:
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), epoch)


def parse_utc(text: Column, pattern: str | None = None) -> Column:
    """Text in UTC to a timestamp; text that does not fit becomes null.

    The zone is part of the parsed text, so a wall clock that the session
    zone skips in spring still parses.
    """
    zoned = F.concat(text, F.lit("Z"))
    pattern = (pattern or DEFAULT_FORMAT) + "X"
    return _instant_to_utc(F.try_to_timestamp(zoned, F.lit(pattern)))


def as_utc(column: Column, data_type: T.DataType, pattern: str | None = None) -> Column:
    """Text, date, instant or NTZ column as a UTC ``TIMESTAMP_NTZ``."""
    if isinstance(data_type, T.StringType):
        return parse_utc(column, pattern)
    if isinstance(data_type, T.TimestampType):
        return _instant_to_utc(column)
    return column.cast("timestamp_ntz")


def parse_day(text: Column) -> Column:
    """``dd/MM/yyyy`` text to midnight; null when it is not a real day."""
    shape = r"^(\d{1,2})/(\d{1,2})/(\d{4})\z"
    iso = F.regexp_replace(text, shape, "$3-$2-$1")
    return F.when(text.rlike(shape), iso.try_cast("date").cast("timestamp_ntz"))


def local(utc: Column) -> Column:
    """Local wall clock of a UTC column."""
    return F.convert_timezone(F.lit("UTC"), F.lit(LOCAL_ZONE), utc)


def local_date(utc: Column) -> Column:
    return local(utc).cast("date")


def seconds_between(start: Column, end: Column) -> Column:
    return (end - start).cast("interval second").cast("decimal(18,6)")


def minutes_between(start: Column, end: Column) -> Column:
    """Duration rounded to the minute, halves to the even minute."""
    return F.rint(seconds_between(start, end).cast("double") / 60).cast("bigint")


def whole_days(minutes: Column) -> Column:
    """Whole days of a duration in minutes, rounded down (also below zero)."""
    return F.floor(minutes / _MINUTES_PER_DAY)


def fractional_days(minutes: Column) -> Column:
    return minutes / F.lit(float(_MINUTES_PER_DAY))


def add_business_days(wall: Column, days: int) -> Column:
    """``days`` working days (Mon-Fri) after a wall clock, time of day kept.

    Closed form: a weekend start counts from the Friday before it, and every
    five working days passed add a weekend.
    """
    weekday = F.weekday(wall.cast("date"))
    back = F.greatest(weekday - 4, F.lit(0))
    weekends = F.floor((F.least(weekday, F.lit(4)) + days) / 5)
    shift = F.lit(days) + 2 * weekends - back
    return F.timestamp_add("DAY", shift.cast("bigint"), wall)


def _weekdays_before(day: Column) -> Column:
    """Working days between Monday 1970-01-05 and the day before ``day``."""
    offset = F.unix_date(day) - 4
    return 5 * F.floor(offset / 7) + F.least(F.pmod(offset, F.lit(7)), F.lit(5))


def business_days_between(first: Column, last: Column) -> Column:
    """Working-day steps of a daily range that starts at ``first``.

    A weekend start moves to Monday; only when the start is a working day
    does a weekend end move back to Friday.  The last day counts only if the
    time of day of the start is reached on it.
    """
    first_weekday = F.weekday(first.cast("date"))
    last_weekday = F.weekday(last.cast("date"))
    first_off, last_off = first_weekday >= 5, last_weekday >= 5
    start = F.when(
        first_off, F.timestamp_add("DAY", (7 - first_weekday).cast("bigint"), first)
    ).otherwise(first)
    end = F.when(
        ~first_off & last_off,
        F.timestamp_add("DAY", (4 - last_weekday).cast("bigint"), last),
    ).otherwise(last)

    start_day, end_day = start.cast("date"), end.cast("date")
    days = _weekdays_before(F.date_add(end_day, 1)) - _weekdays_before(start_day)
    early = (end - end_day.cast("timestamp_ntz")) < (
        start - start_day.cast("timestamp_ntz")
    )
    partial = F.when((F.weekday(end_day) < 5) & early, 1).otherwise(0)
    return F.greatest(days - partial, F.lit(0)).cast("bigint")


def day_text(wall: Column) -> Column:
    """``yyyy-MM-dd``."""
    return F.substring(wall.cast("string"), 1, 10)


def short_text(wall: Column) -> Column:
    """``dd/MM/yy HH:mm``."""
    text = wall.cast("string")

    def part(position: int, length: int) -> Column:
        return F.substring(text, position, length)

    slash = F.lit("/")
    return F.concat(
        part(9, 2), slash, part(6, 2), slash, part(3, 2), F.lit(" "), part(12, 5)
    )


def calendar_millis_text(utc: Column) -> Column:
    """Milliseconds since local midnight of 1970-01-01, as text; '' for null."""
    origin = F.lit("1969-12-31 23:00:00").cast("timestamp_ntz")
    millis = F.floor(seconds_between(origin, utc) * 1000)
    return F.coalesce(millis.cast("bigint").cast("string"), F.lit(""))
