"""Random draws that depend only on (seed, table, row number, purpose).

A row is the same whatever the partitioning, and a lost task makes the same rows again.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

RESOLUTION = 1 << 53


@dataclass(frozen=True)
class Draws:
    seed: int
    table: str
    row: Column

    def _bits(self, purpose: str) -> Column:
        return F.xxhash64(F.lit(self.seed), F.lit(self.table), F.lit(purpose), self.row)

    def uniform(self, purpose: str) -> Column:
        """A double in [0, 1)."""
        return F.pmod(self._bits(purpose), F.lit(RESOLUTION)) / F.lit(float(RESOLUTION))

    def integer(self, purpose: str, low: int | Column, high: int | Column) -> Column:
        """A whole number from ``low`` up to but not including ``high``."""
        first = F.lit(low) if isinstance(low, int) else low
        span = (F.lit(high) if isinstance(high, int) else high) - first
        return (first + F.floor(self.uniform(purpose) * span)).cast("long")

    def chance(self, purpose: str, probability: float) -> Column:
        return self.uniform(purpose) < probability

    def pick(self, purpose: str, values: Sequence[object]) -> Column:
        """One of the values, all equally likely."""
        options = F.array(*[F.lit(v) for v in values])
        return F.element_at(options, (self.integer(purpose, 0, len(values)) + 1).cast("int"))

    def weighted(self, purpose: str, weights: Mapping[str, float]) -> Column:
        """One of the keys, as likely as its weight; weights add up to 1."""
        draw, reached, chosen = self.uniform(purpose), 0.0, None
        *head, last = weights
        for value in head:
            reached += weights[value]
            condition = draw < reached
            chosen = F.when(condition, value) if chosen is None else chosen.when(condition, value)
        return F.lit(last) if chosen is None else chosen.otherwise(last)

    def normal(self, purpose: str, sigma: float) -> Column:
        """A normal deviate around 0, from two uniforms."""
        radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - self.uniform(purpose + "/r")))
        return radius * F.cos(F.lit(2.0 * math.pi) * self.uniform(purpose + "/a")) * F.lit(sigma)

    def poisson(self, purpose: str, mean: float) -> Column:
        """A Poisson count: how many steps of the distribution function lie at or below the draw."""
        steps, term, reached, k = [], math.exp(-mean), 0.0, 0
        while reached + term > reached:
            reached += term
            steps.append(reached)
            k += 1
            term *= mean / k
        draw = self.uniform(purpose)
        return sum(((draw >= s).cast("int") for s in steps), F.lit(0))

    def uuid(self, purpose: str) -> Column:
        """Text in the shape of a UUID."""
        digits = F.concat(
            F.lpad(F.lower(F.hex(self._bits(purpose + "/hi"))), 16, "0"),
            F.lpad(F.lower(F.hex(self._bits(purpose + "/lo"))), 16, "0"),
        )
        parts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
        return F.concat_ws("-", *[F.substring(digits, start, length) for start, length in parts])
