"""Bronze and silver steps: audit columns, de-duplication, casts, text folding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motorpool.functions import calendar, text
from motorpool.schemas import Entity

AUDIT_COLUMNS = ("_ingested_at", "_source_system", "_source_layer", "_batch_id")


def with_audit(
    df: DataFrame,
    source_system: str,
    layer: str,
    batch_id: str,
    at: datetime | str | None = None,
) -> DataFrame:
    """Add the four ingestion audit columns; ``batch_id`` is one value for the whole run."""
    return df.withColumns(
        {
            "_ingested_at": calendar.instant(at),
            "_source_system": F.lit(source_system),
            "_source_layer": F.lit(layer),
            "_batch_id": F.lit(batch_id),
        }
    )


def read_without(df: DataFrame, columns: Sequence[str] = AUDIT_COLUMNS) -> DataFrame:
    """Drop the named columns where present."""
    return df.drop(*columns)


def dedup(df: DataFrame, key: str | Sequence[str], order_by: Sequence[Column] = ()) -> DataFrame:
    """One row per key, null keys dropped.

    ``order_by`` decides which row survives; remaining ties are broken by all other columns, so
    the result does not depend on partitioning. Spark limits each map task to its best row per
    key before the shuffle, so a key that repeats in a third of the rows stays cheap.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [F.col(c).asc_nulls_last() for c in df.columns if c not in keys]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by, *rest))
    present = df.dropna(subset=keys)
    return present.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def latest_per(df: DataFrame, key: str | Sequence[str], ts: str) -> DataFrame:
    """The most recent row of each key."""
    return dedup(df, key, [F.col(ts).desc_nulls_last()])


def _number(col: Column) -> Column:
    """Text to double. Only text that may be a number is tried: a parse that fails costs an exception per value."""
    return F.when(col.rlike("[0-9]|(?i:nan|inf)"), col).try_cast("double")


def _cast(df: DataFrame, column: str, dtype: str) -> Column:
    source = df.schema[column].dataType
    col = F.col(column)
    if dtype == "timestamp" and isinstance(source, T.StringType):
        return calendar.parse_iso(col)
    if dtype == "date":
        return col.try_cast("date")
    whole = dtype in ("int", "long")
    if isinstance(source, (T.FloatType, T.DoubleType)):
        # A missing number may arrive as NaN; a fraction is no whole number.
        col = F.when(~F.isnan(col) & (F.lit(not whole) | (col == F.rint(col))), col)
    elif whole and isinstance(source, T.StringType):
        # "2500.0" is how a nullable integer looks in some CSV exports; "2500.7" is not one. A plain cast would cut it.
        number = _number(col)
        as_whole = F.when(number == F.rint(number), number.try_cast(dtype))
        return F.when(col.contains("."), as_whole).otherwise(F.coalesce(col.try_cast(dtype), as_whole))
    elif dtype == "double" and isinstance(source, T.StringType):
        return _number(col)
    return col.try_cast(dtype)


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast columns, turning values that do not parse into null."""
    return df.withColumns({c: _cast(df, c, t) for c, t in types.items()})


def normalize_text(df: DataFrame, modes: Mapping[str, str]) -> DataFrame:
    """Apply ``trim``, ``upper`` or ``lower`` per column; the folds trim as well."""
    return df.withColumns({c: text.normalised(c, m) for c, m in modes.items()})


def rental_days(df: DataFrame) -> DataFrame:
    days = calendar.rental_days_calendar(F.col("pickup_ts"), F.col("return_ts"))
    return df.withColumn("rental_days", days)


def to_silver(entity: Entity, bronze: DataFrame, order_by: Sequence[Column] = ()) -> DataFrame:
    """Clean one entity by its declaration: drop audit columns, cast, fold text, de-duplicate.

    Columns the declaration does not know are carried through, so a source may add columns.
    Values are typed before duplicates are dropped, which makes the rows that are shuffled
    narrower than their text.
    """
    df = read_without(bronze)
    df = cast_columns(df, {c: t for c, t in entity.types.items() if c in df.columns})
    folds = {c: m for c, m in entity.text.items() if c in df.columns}
    df = dedup(normalize_text(df, folds) if folds else df, entity.key, order_by)
    return rental_days(df) if entity.name == "rentals" else df
