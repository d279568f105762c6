"""Stored groupings of a fact, from which questions on coarser groupings are answered.

A cuboid holds the states of some aggregates per group of some columns of a table. A question can be answered from it
if all columns it groups or filters by are among the cuboid's, or reached through them, and if its aggregates can be
derived: sums, counts, means and extremes from their states, a distinct count from bitmaps of that column or if the
column itself is a key. Of several cuboids that can answer, the one with the fewest stored rows does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from motorpool.functions import states
from motorpool.functions.states import Aggregate


@dataclass(frozen=True)
class Cuboid:
    """Stored states of a table by ``keys``; ``distinct`` is the column whose values its bitmaps hold."""

    keys: frozenset[str]
    data: DataFrame
    rows: int
    distinct: str | None = None

    def answers(self, columns: Iterable[str], aggregates: Iterable[Aggregate]) -> bool:
        return set(columns) <= self.keys and all(states.holds(self.data.columns, a, self.distinct) for a in aggregates)


Store = Callable[[DataFrame], DataFrame]


def build(table: DataFrame, keys: Sequence[str], aggregates: Sequence[Aggregate], store: Store) -> Cuboid:
    """Group a table once and store the states.

    ``store`` writes a DataFrame and reads it back. Ids that are not whole numbers become a key of the cuboid where
    they are counted.
    """
    data = store(states.partial(table, keys, aggregates))
    counted = next((a.distinct for a in aggregates if a.distinct), None)
    held = frozenset(keys) | ({counted} if counted in data.columns else set())
    return Cuboid(held, data, data.count(), counted)


def coarser(cuboid: Cuboid, keys: Sequence[str], aggregates: Sequence[Aggregate], store: Store) -> Cuboid:
    """A cuboid by fewer keys, from the states of a finer one."""
    if not cuboid.answers(keys, aggregates):
        raise ValueError(f"a cuboid by {sorted(cuboid.keys)} cannot give {[a.name for a in aggregates]} by {list(keys)}")
    data = store(states.regrouped(cuboid.data, keys, aggregates))
    return Cuboid(frozenset(keys) | (set(data.columns) & {cuboid.distinct}), data, data.count(), cuboid.distinct)


def smallest(cuboids: Iterable[Cuboid], columns: Sequence[str], aggregates: Sequence[Aggregate]) -> Cuboid | None:
    """The stored grouping with the fewest rows that can answer, if any."""
    able = [c for c in cuboids if c.answers(columns, aggregates)]
    return min(able, key=lambda c: c.rows, default=None)
