"""Benchmark passages inside documents, allowing for edits.

An item of m characters that stands in a document with at most k edits shares at least m - q + 1 - k * q of its
character q-grams with it, and all of them within k diagonals of each other. Shared q-grams are counted in overlapping
bands of diagonals; only bands that reach the count are aligned, within the band, to learn the true distance. Short
items share too few q-grams for that and are found exactly, between borders of words.

Both sides are compared in a plain form: lower case, letters without their accents (composed or not), everything but
letters and digits as one blank, and "s" for "ß" and runs of "s", so that upper case ("SS") and decoration hide nothing.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorpool.llm.common import claim, per_row, stretches, text_or_empty

Q = 8
# Edits allowed for each character of an item; items shorter than this are matched without any, on borders of words.
EDIT_RATE, LEAST_CHARS = 0.08, 32
# From here on (East Asian scripts) signs stand without blanks: each has borders.
UNSPACED = 0x2E80
# Text handled at once, and benchmark text handled in one pass over the documents (its index is broadcast, about
# thirty times as large): more items take more passes.
TEXT_BYTES, ITEM_BYTES = 1 << 20, 4 << 20
GAP, MARK = 1, 2  # between documents, and accents that follow their letter; no plain form contains them
TABLE_BITS = 22
# An item in which a q-gram occurs more often than this is too repetitive for diagonals to tell places apart.
REPEATS = 16
# Postings of shared q-grams held at once.
POSTINGS = 4 << 20


@functools.cache
def _plain_codes() -> np.ndarray:
    table = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        sign = chr(c)
        if sign.isalnum():
            base, *marks = unicodedata.normalize("NFD", sign.lower()[0])
            table[c] = ord(base if all(map(unicodedata.combining, marks)) else sign.lower()[0])
        elif unicodedata.combining(sign):
            table[c] = MARK
    table[[0xDF, 0x1E9E]] = ord("s")
    return table


@dataclass
class Plain:
    """The plain form of several texts with gaps between them."""

    codes: np.ndarray
    place: np.ndarray  # of each code in the texts laid end to end with one sign between
    text: np.ndarray  # where each text begins in ``place``


def plain(texts: list[str]) -> Plain:
    joined = " ".join(texts) + " "
    codes = _plain_codes()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    ends = np.cumsum([len(t) + 1 for t in texts])
    codes[ends - 1] = GAP
    place = np.flatnonzero(codes != MARK)
    codes = codes[place]
    before = np.concatenate(([GAP], codes[:-1]))
    keep = (codes != 0) & ~((codes == ord("s")) & (before == ord("s"))) | (codes == 0) & (before > GAP)
    return Plain(codes[keep], place[keep], np.concatenate(([0], ends[:-1])))


def grams(codes: np.ndarray) -> np.ndarray:
    """A hash of the Q codes from each position on, by doubling (Q is a power of two)."""
    held = codes.astype(np.uint64)
    width, base = 1, 0x9E3779B97F4A7C15
    while width < Q:
        if len(held) <= width:
            return np.zeros(0, dtype=np.uint64)
        held = held[:-width] * np.uint64(base) + held[width:]
        base = base * base % 2**64
        width *= 2
    # Multiplied low bits say little: fold the high ones in.
    return (held ^ (held >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Items:
    """An index of the q-grams of benchmark items."""

    ids: list[int]
    codes: list[np.ndarray]
    budget: np.ndarray  # edits allowed
    needed: np.ndarray  # q-grams that must be shared
    found: np.ndarray  # table over the high bits of hashes
    hashes: np.ndarray  # distinct, sorted
    first: np.ndarray  # of each hash in the postings
    count: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    repetitive: list[tuple[int, np.ndarray]]  # items left out of the postings, with their q-grams
    short: dict[bytes, list[int]]  # codes of short items, which come after all others in ``ids``


def index(items: list[tuple[int, str]], rate: float = EDIT_RATE, least: int = LEAST_CHARS) -> Items:
    """Items whose plain form is shorter than ``least`` are short; one without letters and digits has no form."""
    ids, codes = [], []
    brief: list[tuple[int, np.ndarray]] = []
    for item_id, text in items:
        form = plain([text]).codes
        form = form[form != GAP]
        form = form[:-1] if len(form) and form[-1] == 0 else form
        if len(form) >= max(least, Q):
            ids.append(item_id)
            codes.append(form)
        elif len(form):
            brief.append((item_id, form))
    short: dict[bytes, list[int]] = {}
    for item_id, form in brief:
        short.setdefault(form.tobytes(), []).append(len(ids))
        ids.append(item_id)
    sizes = np.array([len(c) for c in codes], dtype=np.int64)
    budget = np.minimum((sizes * rate).astype(np.int64), np.maximum(sizes - Q, 0) // Q)
    hashed = [grams(c) for c in codes]
    repetitive = [(i, np.unique(h)) for i, h in enumerate(hashed) if np.unique(h, return_counts=True)[1].max() > REPEATS]
    for i, _ in repetitive:
        hashed[i] = hashed[i][:0]
    every = np.concatenate([np.zeros(0, np.uint64), *hashed])
    item = np.repeat(np.arange(len(codes)), [len(h) for h in hashed])
    offset = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(h)) for h in hashed)])
    order = np.argsort(every, kind="stable")
    hashes, first, count = np.unique(every[order], return_index=True, return_counts=True)
    found = np.zeros(1 << TABLE_BITS, dtype=bool)
    found[(hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
    needed = sizes - Q + 1 - budget * Q
    return Items(ids, codes, budget, needed, found, hashes, first, count, item[order], offset[order], repetitive, short)


def aligned(pattern: np.ndarray, text: np.ndarray, anchored: bool) -> tuple[int, int]:
    """Least edits between the pattern and a stretch of the text, and where that stretch ends.

    The stretch starts at the first character if ``anchored``, else anywhere within the slack, which is how much longer
    the text is than the pattern; cells further from the diagonals of the slack are not visited.
    """
    slack = len(text) - len(pattern)
    far = len(pattern) + len(text)
    steps = np.arange(slack + 1)
    row = steps.astype(np.int64) if anchored else np.zeros(slack + 1, dtype=np.int64)
    for i, sign in enumerate(pattern):
        change = row + (text[i : i + slack + 1] != sign)
        change[:-1] = np.minimum(change[:-1], row[1:] + 1)
        row = np.minimum.accumulate(change - steps) + steps
    best = int(row.argmin())
    return (int(row[best]), len(pattern) + best) if row[best] < far else (far, 0)


def _bands(form: Plain, hashed: np.ndarray, items: Items) -> Iterator[tuple[int, int, int]]:
    """(item, low, high): stretches of the plain form that share enough q-grams with an item in a band of diagonals."""
    if not len(items.hashes):
        return
    at = np.flatnonzero(items.found[(hashed >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
    own = hashed[at]
    where = np.minimum(np.searchsorted(items.hashes, own), len(items.hashes) - 1)
    real = items.hashes[where] == own
    at, where = at[real], where[real]
    shift = 2 * max(len(c) for c in items.codes)
    keys, shared = np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.cumsum(items.count[where])
    start = 0
    while start < len(at):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + POSTINGS)))
        pos, gram = at[start:stop], where[start:stop]
        count = items.count[gram]
        total = int(count.sum())
        post = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(items.first[gram], count)
        item = items.item[post]
        diagonal = np.repeat(pos, count) - items.offset[post] + shift
        key, n = np.unique(item.astype(np.int64) << 40 | diagonal // (items.budget[item] + 1), return_counts=True)
        keys, back = np.unique(np.concatenate((keys, key)), return_inverse=True)
        shared = np.bincount(back, np.concatenate((shared, n))).astype(np.int64)
        start = stop
    if not len(keys):
        return
    # A band is a slot and the next one: any budget + 1 diagonals in a row lie within one band. A band whose first
    # slot is empty shares what its second slot does, which is less than the band that begins there.
    follows = np.concatenate((keys[1:] == keys[:-1] + 1, [False]))
    in_band = shared + np.where(follows, np.concatenate((shared[1:], [0])), 0)
    for key in keys[in_band >= items.needed[keys >> 40]].tolist():
        i, slot = key >> 40, key & ((1 << 40) - 1)
        k = int(items.budget[i])
        low, high = slot * (k + 1) - shift - k, (slot + 2) * (k + 1) - shift + len(items.codes[i]) + k
        yield i, max(0, low), min(len(form.codes), high)


def _dense(form: Plain, hashed: np.ndarray, items: Items) -> Iterator[tuple[int, int, int]]:
    """The same for repetitive items: stretches in which enough positions hold any q-gram of the item."""
    for i, own in items.repetitive:
        m, k = len(items.codes[i]), int(items.budget[i])
        seen = np.concatenate(([0], np.cumsum(np.isin(hashed, own))))
        width = min(m + k - Q + 1, len(hashed))
        full = np.flatnonzero(seen[width:] - seen[: len(seen) - width] >= items.needed[i])
        for run in np.split(full, np.flatnonzero(np.diff(full) > m) + 1):
            if len(run):
                yield i, max(0, int(run[0]) - k), min(len(form.codes), int(run[-1]) + m + 2 * k)


def _short(form: Plain, items: Items) -> Iterator[tuple[int, int, int]]:
    """(item, start, end): every place of a short item, hashes of its length compared first."""
    if not items.short or not len(form.codes):
        return
    n, base = len(form.codes), 0x9E3779B97F4A7C15
    powers, inverse = (np.full(n, b, np.uint64) for b in (base, pow(base, -1, 2**64)))
    powers[0] = inverse[0] = 1
    powers, inverse = np.cumprod(powers), np.cumprod(inverse)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(form.codes.astype(np.uint64) * powers)))
    apart = (form.codes <= GAP) | (form.codes >= UNSPACED)
    border = np.concatenate(([True], apart[1:] | apart[:-1], [True]))
    begins = np.flatnonzero(border)
    of_size: dict[int, list[tuple[np.ndarray, list[int]]]] = {}
    for code, which in items.short.items():
        pattern = np.frombuffer(code, form.codes.dtype)
        of_size.setdefault(len(pattern), []).append((pattern, which))
    for size, patterns in of_size.items():
        starts = begins[begins + size <= n]
        starts = starts[border[starts + size]]
        hashed = (total[starts + size] - total[starts]) * inverse[starts]
        sums = [int((p.astype(np.uint64) * powers[:size]).sum(dtype=np.uint64)) for p, _ in patterns if size <= n]
        of_sum: dict[int, list[int]] = {}
        for i, x in enumerate(sums):
            of_sum.setdefault(x, []).append(i)
        likely = np.isin(hashed, np.array(sums, np.uint64))
        for start, x in zip(starts[likely].tolist(), hashed[likely].tolist()):
            for i in of_sum[x]:
                pattern, which = patterns[i]
                if np.array_equal(form.codes[start : start + size], pattern):
                    for item in which:
                        yield item, start, start + size


def matches(texts: list[str], items: Items) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) of every place where an item stands, in code points of the text.

    Of places of one item that overlap the one with the fewest edits counts, the first of equals.
    """
    if not items.ids or not texts:
        return []
    form = plain(texts)
    hashed = grams(form.codes)
    gaps = np.flatnonzero(form.codes == GAP)
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for i, low, high in (*_bands(form, hashed, items), *_dense(form, hashed, items)):
        pattern, k = items.codes[i], int(items.budget[i])
        # Each document the stretch touches is tried by itself.
        cuts = gaps[(gaps >= low) & (gaps < high)]
        todo = list(zip([low, *(cuts + 1).tolist()], [*cuts.tolist(), high]))
        while todo:
            a, b = todo.pop()
            text = form.codes[a:b]
            if len(text) + k < len(pattern):
                continue
            # Room on both sides, for items whose first or last characters are missing at the border of a document.
            room = np.full(k, GAP, text.dtype)
            padded = np.concatenate((room, text, np.full(max(0, len(pattern) - len(text)), GAP, text.dtype), room))
            edits, end = aligned(pattern, padded, anchored=False)
            end = min(end - k, len(text))
            if edits > k or end <= 0:
                continue
            back = np.concatenate((text[:end][::-1], np.full(max(0, len(pattern) - end) + k, GAP, text.dtype)))
            _, length = aligned(pattern[::-1], back[: len(pattern) + k], anchored=True)
            start = max(0, end - length)
            first, last = form.place[a + start], form.place[a + end - 1]
            t = int(np.searchsorted(form.text, first, side="right")) - 1
            found.setdefault((t, i), []).append((int(first - form.text[t]), int(last - form.text[t]) + 1, edits))
            # The stretch may hold the item again, left or right of here.
            todo += [(a, a + start), (a + end, b)]
    for i, start, end in _short(form, items):
        first, last = form.place[start], form.place[end - 1]
        t = int(np.searchsorted(form.text, first, side="right")) - 1
        found.setdefault((t, i), []).append((int(first - form.text[t]), int(last - form.text[t]) + 1, 0))
    kept = []
    for (t, i), places in found.items():
        taken: list[tuple[int, int, int]] = []
        for start, end, edits in sorted(set(places), key=lambda p: (p[2], p[0], p[1])):
            if all(end <= a or b <= start for a, b, _ in taken):
                taken.append((start, end, edits))
        kept += [(t, i, *p) for p in taken]
    return sorted(kept)


def _passes(benchmark: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The items in portions of bounded size, one at a time on the driver."""
    portion, held = [], 0
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(key).cast("long"), F.col(text).cast("string"))
    for item_id, t in rows.toLocalIterator():
        portion.append((item_id, t))
        held += len(t)
        if held >= ITEM_BYTES:
            yield portion
            portion, held = [], 0
    if portion:
        yield portion


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    rate: float = EDIT_RATE,
    least: int = LEAST_CHARS,
) -> DataFrame:
    """One row for each place where an item stands in a document: ``key``, ``item_id``, ``start``, ``end``, ``edits``.

    Every whole text is searched for every item, those with fewer than ``least`` plain characters without edits and on
    borders of words, however short; an item without letters and digits matches nothing. Null texts and items match
    nothing; equal items are each reported; repeated documents give repeated rows; documents without a match give none.
    The benchmark passes through the driver in portions of ITEM_BYTES, each broadcast for one pass over the documents.
    """
    kind = docs.schema[key].dataType.simpleString()
    shape = f"`{key}` {kind}, item_id long, start long, end long, edits int"
    narrow = docs.select(F.col(key), text_or_empty(text).alias("__text"))
    parts = []
    for portion in _passes(benchmark, item_key, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(index(portion, rate, least))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            claim(__name__)
            items = shared.value
            for batch in stretches(batches, limit=TEXT_BYTES):
                keys = batch.column(0)
                for part in _portions(batch.column(1).to_pylist()):
                    rows = matches([t for _, t in part], items)
                    if rows:
                        which = pa.array([part[r[0]][0] for r in rows], pa.int64())
                        columns = [[items.ids[r[1]] for r in rows], *([r[n] for r in rows] for n in (2, 3))]
                        yield pa.RecordBatch.from_arrays(
                            [keys.take(which), *(pa.array(c, pa.int64()) for c in columns), pa.array([r[4] for r in rows], pa.int32())],
                            [key, "item_id", "start", "end", "edits"],
                        )

        parts.append(narrow.mapInArrow(run, shape))
    if not parts:
        return docs.sparkSession.createDataFrame([], shape)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    return found


def _portions(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
    """Non-empty texts with their row, about TEXT_BYTES at a time."""
    part, held = [], 0
    for i, t in enumerate(texts):
        if t:
            part.append((i, t))
            held += len(t)
        if held >= TEXT_BYTES:
            yield part
            part, held = [], 0
    if part:
        yield part


def without_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    rate: float = EDIT_RATE,
    least: int = LEAST_CHARS,
) -> DataFrame:
    """The rows of ``docs``, as they are, in whose text no item stands. One pass over the rows for each portion."""
    kept = docs
    for portion in _passes(benchmark, item_key, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(index(portion, rate, least))

        def build(shared=shared):
            items = shared.value

            def clean(texts: list[str], batch: pa.RecordBatch) -> pa.RecordBatch:
                mask = np.ones(len(texts), dtype=bool)
                for part in _portions(texts):
                    mask[[part[r[0]][0] for r in matches([t for _, t in part], items)]] = False
                return batch.filter(pa.array(mask))

            return clean

        kept = per_row(kept, text, build, limit=TEXT_BYTES)
    return kept
