"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORMALISERS = {
    "trim": F.trim,
    "upper": lambda c: F.upper(F.trim(c)),
    "lower": lambda c: F.lower(F.trim(c)),
}


def normalised(column: str | Column, mode: str) -> Column:
    """Trim, and fold case when ``mode`` is ``upper`` or ``lower``."""
    return NORMALISERS[mode](column)


def not_empty(column: str | Column) -> Column:
    """True when the value is neither null nor the empty string; never null."""
    col = F.col(column) if isinstance(column, str) else column
    return col.isNotNull() & (col != "")


def formatted_key(prefix: str, width: int, number: Column) -> Column:
    """Business key such as ``V00012``: a prefix and a zero-padded number.

    Numbers wider than ``width`` are kept whole, so keys stay unique at any scale.
    """
    return F.format_string(f"{prefix}%0{width}d", number)


def json_value(column: str | Column, path: str, dtype: str = "string") -> Column:
    """The value at a JSON path, typed; null where it is missing or does not parse."""
    return F.get_json_object(column, path).try_cast(dtype)
