"""Maximal periodic runs of words: stretches that repeat themselves with some period at least twice.

All texts of a stretch are compared as one sequence of word numbers, with a different separator after each; no run can
hold a separator. Short periods are found by comparing the sequence with itself at every lag. For longer ones there is
a scale for each power of two Q: k-grams of Q/2 words are hashed, and of every Q words in a row the smallest hash is a
minimizer. In a run of period q in [Q, 2Q) the first Q words come again q words later, and so does their minimizer:
pairs of equal minimizers at a distance in [Q, 2Q) are seeds, which are extended word by word at their lag.

A k-gram that is itself periodic with at most half its length would pair up with itself over and over. It comes after
all others in the order of hashes, and is never a seed. That misses only runs the repeated part of which lies wholly
inside a run of a much shorter period, found at an earlier scale. Their two copies then lie in two such runs, of equal
period and touching each other, so the lags at which two touching runs agree are tried directly. No other k-gram stands
more often than eight times within reach, so there are at most eight pairs for each minimizer.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorpool.llm.common import stretches, text_or_empty

LEAST_WORDS, LEAST_TIMES = 12, 2
# Periods below this are found by direct lag scans; a power of two.
SCANNED = 32
# Words compared in the first step of an extension; every further step doubles.
REACH = 16
MULTIPLIER = 0x9E3779B97F4A7C15
TOP = np.uint64(1 << 63)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def agree_after(x: np.ndarray, i: int, lag: int) -> int:
    """How many positions from i on hold the same as those ``lag`` later."""
    end, at, step = len(x) - lag, i, REACH
    while at < end:
        stop = min(end, at + step)
        apart = x[at:stop] != x[at + lag : stop + lag]
        first = int(apart.argmax())
        if apart[first]:
            return at + first - i
        at, step = stop, step * 2
    return max(0, end - i)


def agree_before(x: np.ndarray, i: int, lag: int) -> int:
    """How many positions just before i hold the same as those ``lag`` later."""
    at, step = i, REACH
    while at > 0:
        start = max(0, at - step)
        apart = (x[start:at] != x[start + lag : at + lag])[::-1]
        first = int(apart.argmax())
        if apart[first]:
            return i - at + first
        at, step = start, step * 2
    return i


def sliding(values: np.ndarray, width: int, best: np.ufunc, worst: int) -> np.ndarray:
    """``best`` of every ``width`` values in a row, by running bests of blocks from both ends."""
    held = np.concatenate((values, np.full(-len(values) % width, worst, values.dtype))).reshape(-1, width)
    up = best.accumulate(held, axis=1).ravel()
    down = best.accumulate(held[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(down[: len(values) - width + 1], up[width - 1 : len(values)])


class _Found:
    """Runs by start and end; the first period given to a stretch is its smallest."""

    def __init__(self) -> None:
        self.period: dict[tuple[int, int], int] = {}

    def add(self, start: int, end: int, period: int) -> None:
        if end - start >= max(LEAST_WORDS, LEAST_TIMES * period):
            self.period.setdefault((start, end), period)

    def table(self) -> np.ndarray:
        """Rows (start, end, period) by start, then period."""
        rows = sorted((a, p, b) for (a, b), p in self.period.items())
        return np.array([(a, b, p) for a, p, b in rows], np.int64).reshape(-1, 3)


def _scan(x: np.ndarray, lags: int, found: _Found) -> None:
    for lag in range(1, min(lags, len(x) // 2 + 1)):
        least = max(LEAST_WORDS - lag, lag)
        apart = np.flatnonzero(x[lag:] != x[:-lag])
        edges = np.concatenate(([-1], apart, [len(x) - lag]))
        gaps = np.diff(edges) - 1
        for g in np.flatnonzero(gaps >= least).tolist():
            found.add(int(edges[g]) + 1, int(edges[g]) + 1 + int(gaps[g]) + lag, lag)


def kgram_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """A hash for every k values in a row: equal ones for equal values, below 2**63."""
    n = len(x)
    powers, back = np.full(n + 1, MULTIPLIER, np.uint64), np.full(n + 1, pow(MULTIPLIER, -1, 1 << 64), np.uint64)
    powers[0] = back[0] = 1
    powers, back = np.cumprod(powers), np.cumprod(back)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed(x.astype(np.uint64) * np.uint64(MULTIPLIER)) * powers[:n])))
    return _mixed((sums[k:] - sums[:-k]) * back[: n - k + 1]) >> np.uint64(1)


def _shift(x: np.ndarray, one: int, other: int, period: int) -> int | None:
    """By how much the period that starts at ``other`` is turned against the one at ``one``; None if they differ."""
    twice = np.concatenate((x[one : one + period], x[one : one + period - 1])).tobytes()
    wanted = x[other : other + period].tobytes()
    at = twice.find(wanted)
    while at >= 0 and at % x.itemsize:
        at = twice.find(wanted, at + 1)
    return None if at < 0 else at // x.itemsize


def _touching(x: np.ndarray, runs: np.ndarray, low: int, found: list[tuple[int, int, int]]) -> None:
    """Runs of a period in [low, 2 * low) whose two copies lie in two touching runs of an equal shorter period."""
    held = runs[np.lexsort((runs[:, 0], runs[:, 2]))].tolist()
    for (c, d, p), (c2, d2, p2) in zip(held, held[1:]):
        if p != p2 or c2 > d:
            continue
        most = min(2 * low - 1, d - c, d2 - c2)
        if most < low or (turn := _shift(x, c, c2, p)) is None:
            continue
        lags = np.arange(low + (c2 - c - turn - low) % p, most + 1, p)
        # What agrees inside the two runs; it goes on beyond them only if they begin or end at once.
        start, stop = np.maximum(c, c2 - lags), np.minimum(d, d2 - lags)
        maybe = (stop - start >= lags) | (((lags == c2 - c) | (lags == d2 - d)) & (stop > start))
        for q, i, j in zip(lags[maybe].tolist(), start[maybe].tolist(), stop[maybe].tolist()):
            i, j = i - agree_before(x, i, q), j + agree_after(x, j, q)
            if j - i >= q:
                found.append((q, i, j + q))


def _seeds(x: np.ndarray, runs: np.ndarray, low: int) -> np.ndarray:
    """Pairs (lag, position) of equal minimizers at a lag in [low, 2 * low), by lag and position."""
    k = low // 2
    keys = kgram_hashes(x, k)
    inside = runs[(runs[:, 2] <= k // 2) & (runs[:, 1] - runs[:, 0] >= k)]
    edge = np.zeros(len(keys) + 1, np.int32)
    np.add.at(edge, inside[:, 0], 1)
    np.add.at(edge, inside[:, 1] - k + 1, -1)
    keys[np.cumsum(edge[:-1]) > 0] |= TOP
    width = low - k + 1
    if len(keys) < width:
        return np.zeros((0, 2), np.int64)
    least = sliding(keys, width, np.minimum, 2**64 - 1)
    around = np.concatenate((np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)))
    chosen = np.flatnonzero((sliding(around, width, np.maximum, 0) == keys) & (keys < TOP))
    order = np.lexsort((chosen, keys[chosen]))
    at, own = chosen[order], keys[chosen][order]
    pairs = []
    for step in range(1, len(at)):
        lag = np.where(own[step:] == own[:-step], at[step:] - at[:-step], 2 * low)
        if not (lag < 2 * low).any():
            break
        hit = (lag >= low) & (lag < 2 * low)
        pairs.append(np.stack((lag[hit], at[:-step][hit]), axis=1))
    if not pairs:
        return np.zeros((0, 2), np.int64)
    every = np.concatenate(pairs)
    return every[np.lexsort((every[:, 1], every[:, 0]))]


def _extended(x: np.ndarray, seeds: np.ndarray, found: list[tuple[int, int, int]]) -> None:
    lag, end = 0, 0
    for q, i in seeds.tolist():
        if q != lag:
            lag, end = q, 0
        if i < end:
            continue  # inside the stretch found last at this lag
        forward = agree_after(x, i, q)
        start, end = i - agree_before(x, i, q), i + forward
        if forward and end - start >= q:
            found.append((q, start, end + q))


def runs_of(x: np.ndarray, longest: np.ndarray | None = None) -> np.ndarray:
    """All runs of a sequence of whole numbers: rows (start, end, smallest period) by start, then period.

    A run has at least LEAST_WORDS members and two periods. ``longest`` holds for every position the length of the part
    it belongs to, if the sequence consists of parts that share no run: longer periods look at longer parts alone.
    """
    found = _Found()
    _scan(x, SCANNED, found)
    longest = np.full(len(x), len(x)) if longest is None else longest
    low, most = SCANNED, int(longest.max(initial=0))
    while 2 * low <= most:
        here = np.flatnonzero(longest >= 2 * low)
        part = x[here]
        runs = found.table()
        runs = runs[longest[runs[:, 0]] >= 2 * low]
        runs[:, 1] += np.searchsorted(here, runs[:, 0]) - runs[:, 0]
        runs[:, 0] = np.searchsorted(here, runs[:, 0])
        longer: list[tuple[int, int, int]] = []
        _touching(part, runs[runs[:, 2] <= low // 4], low, longer)
        _extended(part, _seeds(part, runs, low), longer)
        for q, start, end in sorted(longer):
            found.add(int(here[start]), int(here[start]) + end - start, q)
        low *= 2
    return found.table()


def found_in(texts: list[list[bytes]]) -> tuple[list[list[tuple[int, int, int]]], list[list[bytes]]]:
    """For each list of words its runs (start, length, period) and the words that are kept."""
    numbers: dict[bytes, int] = {}
    sizes = np.array([len(words) for words in texts], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))  # a separator after each text
    x = np.empty(int(starts[-1]), np.int64)
    for i, words in enumerate(texts):
        a = int(starts[i])
        x[a : a + len(words)] = [numbers.setdefault(w, len(numbers)) for w in words]
        x[a + len(words)] = -1 - i
    runs = runs_of(x, np.repeat(sizes, sizes + 1))
    dropped = np.zeros(len(x) + 1, np.int64)
    np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
    np.add.at(dropped, runs[:, 1], -1)
    kept = np.cumsum(dropped[:-1]) == 0
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for i, (start, end, period) in zip((np.searchsorted(starts, runs[:, 0], side="right") - 1).tolist(), runs.tolist()):
        found[i].append((start - int(starts[i]), end - start, period))
    left = [
        list(compress(words, kept[a : a + len(words)].tolist())) if of else words for words, of, a in zip(texts, found, starts.tolist())
    ]
    return found, left


RUNS = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed`` of every row.

    Words are what blanks and the control characters 9 to 13 separate, numbered from 0. A run is a stretch of words
    with a smallest period of which it holds two times or more, at least 12 words long, that neither neighbour carries
    on. Texts are searched whole and for every period. ``collapsed`` joins by one blank the words that no run holds
    after its first period. Null, empty and blank texts have no words, no runs and an empty ``collapsed``; null and
    repeated keys are rows like any other; an empty table gives no rows. Nothing is shuffled.
    """
    narrow = docs.select(F.col(key).alias("__key"), text_or_empty(text).alias("__text"))
    kind = narrow.schema["__key"].dataType.simpleString()
    schema = docs.sparkSession.createDataFrame([], f"`{key}` {kind}, {RUNS}").schema
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stretches(batches):
            texts = [t.split() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            found, kept = found_in(texts)
            flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
            ends = np.concatenate(([0], np.cumsum([len(runs) for runs in found]))).astype(np.int32)
            rows = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), rows),
                    pa.array([b" ".join(words) for words in kept], pa.binary()).view(pa.string()),
                ],
                names,
            )

    return narrow.mapInArrow(run, schema)
