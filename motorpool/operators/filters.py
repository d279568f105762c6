"""Row filters that the reference questions use; all push down to the scan."""

from __future__ import annotations

import operator
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorpool.functions import calendar, text

COMPARISONS = {
    ">": operator.gt,
    ">=": operator.ge,
    "<": operator.lt,
    "<=": operator.le,
    "=": operator.eq,
    "<>": operator.ne,
}


def threshold(df: DataFrame, column: str, op: str, value: object) -> DataFrame:
    return df.filter(COMPARISONS[op](F.col(column), F.lit(value)))


def with_value(df: DataFrame, column: str) -> DataFrame:
    return df.filter(text.not_empty(column))


def in_range(df: DataFrame, ts: str, start: object, end: object) -> DataFrame:
    """Closed range: both ends belong to it."""
    return df.filter(F.col(ts).between(F.lit(start), F.lit(end)))


def one_way(df: DataFrame) -> DataFrame:
    return df.filter(F.col("is_one_way"))


def retain(df: DataFrame, ts: str, days: int, as_of: datetime | Column) -> DataFrame:
    """Rows no older than ``days`` at ``as_of``."""
    moment = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return df.filter(F.col(ts) >= moment - F.make_dt_interval(F.lit(days)))


def hot_set(df: DataFrame, ts: str, as_of: datetime | Column, days: int = 7) -> DataFrame:
    """The recent slice that is kept close at hand; a shorter :func:`retain`."""
    return retain(df, ts, days, as_of)


def new_since(df: DataFrame, ingested_at: str, watermark: object) -> DataFrame:
    """Rows that arrived after the last look."""
    moment = watermark if isinstance(watermark, Column) else F.lit(watermark)
    return df.filter(F.col(ingested_at) > moment)


def freshness_minutes(ts: Column, as_of: datetime | str | Column | None) -> Column:
    return F.round(calendar.minutes_between(ts, calendar.instant(as_of)), 1)
