"""Files laid out so that filters on any of several columns skip most of them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of each column in the order: 2^BITS ranges of about as many rows each.
BITS = 8


def _ranges(df: DataFrame, columns: Sequence[str], bits: int) -> dict[str, list]:
    """Borders that cut the values of each column into ranges of about equal rows, from one pass; 2^bits at most."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = df.agg(*[F.percentile_approx(_number(df, c), shares, 20_000).alias(c) for c in columns]).first()
    return {c: sorted(set(found[c] or [])) for c in columns}


def _number(df: DataFrame, column: str) -> Column:
    """A value that orders like the column: times as microseconds, texts by their first bytes."""
    kind = df.schema[column].dataType.simpleString()
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(column).cast("timestamp"))
    if kind == "date":
        return F.unix_date(column)
    if kind == "boolean":
        return F.col(column).cast("int")
    if kind in ("string", "binary"):
        head = F.rpad(F.hex(F.substring(F.col(column).cast("binary"), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("long")
    return F.col(column)


def _place(value: Column, borders: Sequence) -> Column:
    """The number of the range that holds a value, by a tree of comparisons; null comes first."""

    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value <= F.lit(borders[middle]), within(low, middle)).otherwise(within(middle + 1, high))

    return F.when(value.isNull(), F.lit(0)).otherwise(within(0, len(borders)))


def z_order(df: DataFrame, columns: Sequence[str], bits: int = BITS) -> Column:
    """The place of a row along a curve that goes through all columns alike: their bits taken in turn."""
    borders = _ranges(df, columns, bits)
    places = [_place(_number(df, c), borders[c]) for c in columns]
    taken = [
        F.shiftleft(F.shiftright(p, i).bitwiseAND(F.lit(1)).cast("long"), i * len(columns) + k)
        for i in range(bits)
        for k, p in enumerate(places)
    ]
    return reduce(Column.bitwiseOR, taken)


def clustered(df: DataFrame, columns: Sequence[str], files: int, bits: int = BITS) -> DataFrame:
    """The rows in ``files`` partitions of about equal size, each a compact piece of the space of the columns.

    Written, most files can be skipped by a filter on any of the columns. Rows of a very frequent combination of values
    are spread over several partitions, as their other columns decide among equals.
    """
    if len(columns) * bits > 62:
        raise ValueError(f"{len(columns)} columns of {bits} bits do not fit")
    ordered = df.withColumn("_z", z_order(df, columns, bits)).withColumn("_tie", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    return ordered.repartitionByRange(files, "_z", "_tie").sortWithinPartitions("_z", *columns).drop("_z", "_tie")
