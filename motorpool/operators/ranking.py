"""Ordered answers: top-k, ranks and change between readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(df: DataFrame, by: str, keys: Sequence[str] = ()) -> DataFrame:
    """Largest first, equal values in key order. A stored table has no order: sort on reading."""
    return df.orderBy(F.col(by).desc_nulls_last(), *[F.col(k).asc_nulls_last() for k in keys])


def top_k(
    df: DataFrame,
    by: str,
    k: int,
    keys: Sequence[str] = (),
    within: Sequence[str] = (),
    ties: bool = False,
) -> DataFrame:
    """The ``k`` largest rows by ``by``, overall or in each group of ``within``.

    Equal rows are ordered by ``keys``, then by all other columns, so the choice is the same in
    every run. With ``ties`` all rows equal to the last one kept are kept too and carry
    ``rank``. Spark keeps at most ``k`` rows (plus ties) per map task and group before any
    shuffle; overall, tied rows stay where they are and get their rank from a list of at most
    ``k`` values.
    """
    if ties and not within:
        best = df.select(F.col(by).alias("_value")).orderBy(F.col("_value").desc_nulls_last()).limit(k)
        # At most k rows: the value and how many of the best rows lie before it.
        counts = best.groupBy("_value").agg(F.count("*").alias("_n"))
        before = Window.orderBy(F.col("_value").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
        ranks = counts.select("_value", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + 1).cast("int").alias("rank"))
        return df.join(ranks, F.col(by).eqNullSafe(F.col("_value"))).drop("_value")
    rest = [c for c in df.columns if c != by and c not in keys]
    order = [F.col(by).desc_nulls_last(), *([] if ties else [F.col(c).asc_nulls_last() for c in (*keys, *rest)])]
    if not within:
        return df.orderBy(*order).limit(k)
    window = Window.partitionBy(*within).orderBy(*order)
    position = F.rank() if ties else F.row_number()
    return df.withColumn("rank", position.over(window)).filter(F.col("rank") <= k)


def change(
    df: DataFrame,
    key: str,
    ts: str,
    column: str,
    tiebreak: str,
    slice_unit: str = "day",
    slice_rows: int = 1_000_000,
) -> DataFrame:
    """Each reading with the previous value of its key and the difference to it.

    A plain ``lag`` would sort all readings of a key in one task. Here a key is cut into time
    slices that are sorted on their own; the first reading of a slice takes its predecessor
    from a small table that holds the last reading of every slice. A slice with more than
    ``slice_rows`` readings of one key is cut into as many equal spans of time as that takes.
    Null keys are a key like any other.
    """
    whole = F.date_trunc(slice_unit, ts)
    full = df.groupBy(F.col(key).alias("_key"), whole.alias("_whole")).agg(
        F.ceil(F.count("*") / slice_rows).alias("_parts"), F.min(ts).alias("_from"), F.max(ts).alias("_to")
    )
    full = full.filter("_parts > 1").withColumns({"_from": _micros("_from"), "_to": _micros("_to")})
    same = F.col(key).eqNullSafe(F.col("_key")) & whole.eqNullSafe(F.col("_whole"))
    share = (_micros(ts) - F.col("_from")) / (F.col("_to") - F.col("_from") + 1)
    part = F.coalesce(F.floor(share * F.col("_parts")), F.lit(0)).cast("long")
    sliced = df.join(full, same, "left").withColumn("_slice", F.struct(whole.alias("whole"), part.alias("part")))
    sliced = sliced.drop("_key", "_whole", "_parts", "_from", "_to")
    order = [F.col(ts), F.col(tiebreak)]
    inside = Window.partitionBy(key, "_slice").orderBy(*order)
    moment = F.struct(F.col(ts), F.col(tiebreak))
    closing = sliced.groupBy(key, "_slice").agg(F.max_by(column, moment).alias("_closing"))
    per_key = Window.partitionBy(key).orderBy("_slice")
    carried = closing.select(
        F.col(key).alias("_key"),
        F.col("_slice").alias("_of"),
        F.lag("_closing").over(per_key).alias("_carried"),
    )
    first = F.row_number().over(inside) == 1
    previous = F.lag(column).over(inside)
    return (
        sliced.withColumns({"_first": first, "_previous": previous})
        .join(carried, F.col(key).eqNullSafe(F.col("_key")) & F.col("_slice").eqNullSafe(F.col("_of")), "left")
        .withColumn(f"previous_{column}", F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_previous")))
        .withColumn(f"{column}_change", F.col(column) - F.col(f"previous_{column}"))
        .drop("_slice", "_first", "_previous", "_carried", "_key", "_of")
    )


def _micros(column: str) -> Column:
    """Microseconds since 1970; a time without a zone is taken as it stands."""
    return F.unix_micros(F.col(column).cast("timestamp"))
