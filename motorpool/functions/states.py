"""Aggregates whose partial results can be stored and merged.

An aggregate is described once and used in three ways: directly over rows, as state columns of a finer grouping, and as
the merger of such states into a coarser one. Sums and counts add up, extremes are compared, a mean is a sum and a
count. A distinct count merges as well: whole-number ids are kept as bitmaps of some 32,000 ids each, other ids as one
row per group and id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorpool.functions.money import exact_sum, safe_div

BUCKET = "_bucket"
BITS = "_bits"
WHOLE = {"tinyint", "smallint", "int", "bigint"}


@dataclass(frozen=True)
class State:
    """A stored column: how it is made from rows, and how stored values of it are merged.

    ``signed`` makes it from rows that count by the sign given, so that a row can be taken back; extremes have none.
    """

    name: str
    partial: Callable[[], Column]
    merge: Callable[[str], Column] = F.sum
    signed: Callable[[Column], Column] | None = None


@dataclass(frozen=True)
class Aggregate:
    """A value over rows; calling it gives the plain aggregate. ``distinct`` names the id column of a distinct count."""

    name: str
    states: tuple[State, ...]
    finish: Callable[..., Column]
    distinct: str | None = None

    def __call__(self) -> Column:
        if self.distinct:
            return F.count_distinct(self.distinct)
        return self.finish(*[s.partial() for s in self.states])


def _same(value: Column) -> Column:
    return value


def row_count() -> Aggregate:
    return Aggregate("rows", (State("rows", lambda: F.count(F.lit(1)), signed=F.sum),), _same)


def count_of(column: str) -> Aggregate:
    """Rows that have a value."""
    name = f"count_{column}"
    state = State(name, lambda: F.count(column), signed=lambda sign: F.sum(F.when(F.col(column).isNotNull(), sign).otherwise(0)))
    return Aggregate(name, (state,), _same)


def count_where(column: str) -> Aggregate:
    """Rows for which the column is true; no such row counts as no value."""
    name = f"trues_{column}"
    state = State(name, lambda: F.count_if(column), signed=lambda sign: F.sum(F.when(F.col(column), sign).otherwise(0)))
    return Aggregate(name, (state,), lambda n: F.nullif(n, F.lit(0)))


def total(column: str, of: Callable[[], Column] | None = None) -> Aggregate:
    """Sum of a column, or of an expression that ``column`` then names."""
    name = f"sum_{column}"
    value = of or (lambda: F.col(column))
    return Aggregate(name, (State(name, lambda: F.sum(value()), signed=lambda sign: F.sum(value() * sign)),), _same)


def _exact(column: str) -> State:
    return State(f"exact_{column}", lambda: exact_sum(column), signed=lambda sign: exact_sum(F.col(column) * sign))


def usd(column: str) -> Aggregate:
    """Exact sum of an amount, as a double."""
    return Aggregate(f"usd({column})", (_exact(column),), lambda v: v.cast("double"))


def usd_rounded(column: str) -> Aggregate:
    """Exact sum of an amount, rounded half-up to cents."""
    return Aggregate(f"usd_rounded({column})", (_exact(column),), lambda v: F.round(v, 2).cast("double"))


def usd_mean(column: str) -> Aggregate:
    """Mean over the amounts there are, rounded half-up to cents."""
    states = (_exact(column), *count_of(column).states)
    return Aggregate(f"usd_mean({column})", states, lambda v, n: F.round(safe_div(v.cast("double"), n), 2))


def mean(column: str) -> Aggregate:
    return Aggregate(f"mean({column})", (*total(column).states, *count_of(column).states), safe_div)


def largest(column: str) -> Aggregate:
    name = f"max_{column}"
    return Aggregate(name, (State(name, lambda: F.max(column), F.max),), _same)


def distinct(column: str) -> Aggregate:
    """Different values there are. A partial grouping can hold the states of one such column."""
    return Aggregate(f"distinct({column})", (), _same, column)


def signed(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Aggregate], sign: Column) -> DataFrame:
    """States per group of rows of which ``sign`` says whether they come (1) or go (-1)."""
    fixed = [a.name for a in aggregates if a.distinct or any(s.signed is None for s in a.states)]
    if fixed:
        raise ValueError(f"rows cannot be taken back from {fixed}")
    return df.groupBy(*keys).agg(*[s.signed(sign).alias(s.name) for s in _states(aggregates)])


def _states(aggregates: Iterable[Aggregate]) -> list[State]:
    return list({s.name: s for a in aggregates for s in a.states}.values())


def _id_of(aggregates: Iterable[Aggregate]) -> str | None:
    ids = {a.distinct for a in aggregates if a.distinct}
    if len(ids) > 1:
        raise ValueError(f"one grouping holds distinct values of one column, not of {sorted(ids)}")
    return ids.pop() if ids else None


def partial(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Aggregate]) -> DataFrame:
    """States per group of ``keys``: one row, or one for each bitmap or id where distinct values are counted."""
    own, made, column = list(keys), [s.partial().alias(s.name) for s in _states(aggregates)], _id_of(aggregates)
    if column and column not in keys:
        if dict(df.dtypes)[column] in WHOLE:
            df = df.withColumn(BUCKET, F.bitmap_bucket_number(column))
            own.append(BUCKET)
            made.append(F.bitmap_construct_agg(F.bitmap_bit_position(column)).alias(BITS))
        else:
            own.append(column)
    if not made:
        return df.select(*own).distinct()
    return df.groupBy(*own).agg(*made)


def regrouped(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Aggregate]) -> DataFrame:
    """States per group of fewer keys, from states."""
    own, column = list(keys), _id_of(aggregates)
    made = [s.merge(f"`{s.name}`").alias(s.name) for s in _states(aggregates)]
    if column and column not in keys:
        if BITS in df.columns:
            own.append(BUCKET)
            made.append(F.bitmap_or_agg(BITS).alias(BITS))
        else:
            own.append(column)
    return df.groupBy(*own).agg(*made) if made else df.select(*own).distinct()


def holds(columns: Iterable[str], aggregate: Aggregate, distinct_of: str | None) -> bool:
    """Whether stored columns hold the states of an aggregate; ``distinct_of`` is the column their bitmaps are of."""
    have = set(columns)
    if aggregate.distinct:
        return aggregate.distinct in have or BITS in have and distinct_of == aggregate.distinct
    return {s.name for s in aggregate.states} <= have


def _finished(df: DataFrame, keys: Sequence[str | Column], measures: Mapping[str, Aggregate]) -> DataFrame:
    values = [
        (F.col(_distinct_name(a)) if a.distinct else a.finish(*[F.col(f"`{s.name}`") for s in a.states])).alias(n)
        for n, a in measures.items()
    ]
    return df.select(*keys, *values)


def _distinct_name(a: Aggregate) -> str:
    return f"_distinct_{a.distinct}"


def _merged_columns(df: DataFrame, measures: Mapping[str, Aggregate]) -> list[Column]:
    return [s.merge(f"`{s.name}`").alias(s.name) for s in _states(measures.values())]


def merged(df: DataFrame, keys: Sequence[str], measures: Mapping[str, Aggregate]) -> DataFrame:
    """Values per group of ``keys`` from states of a finer grouping."""
    column, made = _id_of(measures.values()), _merged_columns(df, measures)
    if column and BITS in df.columns:
        by_bucket = df.groupBy(*keys, BUCKET).agg(F.bitmap_or_agg(BITS).alias(BITS), *made)
        df, made = by_bucket, [*_merged_columns(by_bucket, measures), F.sum(F.bitmap_count(BITS)).alias(f"_distinct_{column}")]
    elif column:
        made.append(F.count_distinct(column).alias(f"_distinct_{column}"))
    return _finished(df.groupBy(*keys).agg(*made), [F.col(k) for k in keys], measures)


def opened(df: DataFrame, levels: Sequence[str], measures: Mapping[str, Aggregate]) -> DataFrame:
    """Values at every depth of a hierarchy from states of its finest level; ``depth`` is 0 for the total."""
    column, made = _id_of(measures.values()), _merged_columns(df, measures)
    depth = (F.lit(len(levels)) - F.bit_count(F.grouping_id())).cast("int").alias("depth")
    if column and BITS in df.columns:
        sets = [[*levels[:i], BUCKET] for i in range(len(levels) + 1)]
        deep = df.groupingSets([[F.col(c) for c in s] for s in sets], *levels, BUCKET).agg(
            depth, F.bitmap_or_agg(BITS).alias(BITS), *made
        )
        counted = F.coalesce(F.sum(F.bitmap_count(BITS)), F.lit(0).cast("long")).alias(f"_distinct_{column}")
        grouped = deep.groupBy(*levels, "depth").agg(*_merged_columns(deep, measures), counted)
    else:
        if column:
            made.append(F.count_distinct(column).alias(f"_distinct_{column}"))
        grouped = df.rollup(*levels).agg(depth, *made)
    return _finished(grouped, [*levels, "depth"], measures)
