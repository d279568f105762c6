"""Date and time expressions, all in UTC."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: raw files carry ISO-8601 UTC text with a literal Z.
ISO_UTC = "yyyy-MM-dd'T'HH:mm:ss'Z'"
ISO_SHAPE = r"^(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z\z"

SECONDS_PER_DAY = 86400


def parse_iso(column: str | Column) -> Column:
    """ISO-8601 text to timestamp, null where the text does not parse.

    Text of the usual shape is cast, which takes a fraction of the time the pattern takes. Text without
    a digit is no time and is not tried: a parse that fails costs an exception per value.
    """
    col = F.col(column) if isinstance(column, str) else column
    plain = F.left(col, F.lit(len("yyyy-MM-ddTHH:mm:ss"))).try_cast("timestamp")
    rest = F.when(col.rlike("[0-9]"), F.try_to_timestamp(col, F.lit(ISO_UTC)))
    return F.when(col.rlike(ISO_SHAPE), plain).otherwise(rest)


def format_iso(column: str | Column) -> Column:
    """Timestamp to ISO-8601 text; inverse of :func:`parse_iso` in a UTC session."""
    return F.date_format(column, ISO_UTC)


def month_of(ts: str | Column) -> Column:
    """First day of the month as a date."""
    return F.trunc(ts, "month")


def days_in_month(day: str | Column) -> Column:
    return F.dayofmonth(F.last_day(day))


def month_number(day: str | Column) -> Column:
    """Months since year 0, so that differences count calendar months."""
    return F.year(day) * 12 + F.month(day)


def epoch_seconds(ts: str | Column) -> Column:
    """Whole seconds since 1970 for a timestamp with or without a zone."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_timestamp(col.cast("timestamp"))


def rental_days_calendar(start: Column, end: Column) -> Column:
    """Midnights crossed, at least 1; null while the rental is open."""
    return F.when(end.isNotNull(), F.greatest(F.lit(1), F.datediff(end, start)))


def rental_days_elapsed(start: Column, end: Column) -> Column:
    """Whole 24-hour periods, at least 1; null while the rental is open."""
    periods = F.floor((epoch_seconds(end) - epoch_seconds(start)) / SECONDS_PER_DAY).cast("int")
    return F.when(end.isNotNull(), F.greatest(F.lit(1), periods))


def instant(value: datetime | str | Column | None) -> Column:
    """A point in time as a column; the wall clock only when none is given."""
    if value is None:
        return F.current_timestamp()
    if isinstance(value, Column):
        return value
    return F.lit(value).cast("timestamp")


def minutes_between(earlier: Column, later: Column) -> Column:
    return (epoch_seconds(later) - epoch_seconds(earlier)) / F.lit(60.0)
