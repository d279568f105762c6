"""Vectors as one-byte codes per part, by integer codebooks and an early-ending nearest-entry search.

Components become whole numbers. Parts of vectors and codebook entries are padded with zeros to a power of two N and
put through a Walsh-Hadamard transform of additions and subtractions alone. The transform keeps squared distances but
for the factor N, so the squared differences of coefficients may be added up one after another, coarse ones (few sign
changes) first; an entry is out as soon as its sum exceeds the distance of an entry that is known in full. All
arithmetic is on whole numbers: ties and sums are exact, and the result does not depend on the order of rows.

Every round of the codebooks is one pass over the stored vectors. Tasks return sums and counts for each entry, which
are added up in the shuffle; only the codebooks themselves, a fixed number of entries, reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorpool.llm.common import written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
# Coefficients added between two looks at which entries are out, and the share of entries that has to be left for these
# to be listed one by one; until then it is faster to go on with the whole table.
STEP, LISTED = 4, 1 / 8
# Parts compared at once: a table of so many rows and all entries stays in the cache of a core.
ROWS = 512
# Whole numbers above 64 bits travel as pieces of so many bits; a double times 2^10 has 1,034 bits at most.
LIMB, LIMBS = 30, 35


def sequency(n: int) -> np.ndarray:
    """Natural row numbers of the Hadamard matrix of order n (a power of two), by rising number of sign changes."""
    bits = n.bit_length() - 1
    gray = [i ^ (i >> 1) for i in range(n)]
    return np.array([int(f"{g:0{bits}b}"[::-1], 2) if bits else 0 for g in gray])


def transformed(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, padded with zeros to a power of two, in sequency order."""
    size = 1 << max(0, (x.shape[1] - 1).bit_length())
    held = np.zeros((len(x), size), x.dtype)
    held[:, : x.shape[1]] = x
    half = 1
    while half < size:
        pairs = held.reshape(len(x), -1, 2, half)
        held = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(len(x), size)
        half *= 2
    return held[:, sequency(size)]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each transformed row the nearest transformed entry (the first of equal ones) and their squared distance
    times the row length."""
    n, width = x.shape
    total = np.zeros((n, len(entries)), x.dtype)
    least = None
    for c in range(0, width, STEP):
        for i in range(c, min(c + STEP, width)):
            apart = x[:, i, None] - entries[None, :, i]
            total += apart * apart
        # The entry that leads so far, measured in full, is what the others have to beat.
        lead = total.argmin(axis=1)
        rest = x[:, c + STEP :] - entries[lead, c + STEP :]
        full = total[np.arange(n), lead] + (rest * rest).sum(axis=1)
        least = full if least is None else np.minimum(least, full)
        left = total <= least[:, None]
        if left.mean() <= LISTED:
            break
    row, entry = np.nonzero(left)
    total = total[row, entry]
    for c in range(c + STEP, width, STEP):
        apart = x[row, c : c + STEP] - entries[entry, c : c + STEP]
        total = total + (apart * apart).sum(axis=1)
        keep = total <= least[row]
        row, entry, total = row[keep], entry[keep], total[keep]
    # Rows are in order, and so are the entries of each.
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    best = np.minimum.reduceat(total, starts)
    hits = np.flatnonzero(total == best[row])
    return entry[hits[np.unique(row[hits], return_index=True)[1]]], best


@dataclass
class Codebooks:
    """Entries of every part: whole numbers, parts x entries x components of a part."""

    entries: np.ndarray
    scale: int

    def whole(self, vectors: list[np.ndarray]) -> np.ndarray:
        """The components of vectors as whole numbers, cut into parts: rows x parts x components."""
        parts, _, size = self.entries.shape
        found = np.zeros((len(vectors), parts * size), self.entries.dtype)
        for i, v in enumerate(vectors):
            if self.entries.dtype == object:
                found[i, : len(v)] = [floor(x * self.scale) if abs(x) < 2.0**500 else int(x) * self.scale for x in v.tolist()]
            else:
                found[i, : len(v)] = np.floor(v * self.scale)
        return found.reshape(len(vectors), parts, size)

    def assigned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each part, and the squared distances summed over the parts."""
        codes, errors = np.zeros(x.shape[:2], np.int64), np.zeros(len(x), x.dtype)
        for p, book in enumerate(self.entries):
            entries = transformed(book)
            for i in range(0, len(x), ROWS):
                own, far = nearest(transformed(x[i : i + ROWS, p]), entries)
                codes[i : i + ROWS, p] = own
                errors[i : i + ROWS] += far // entries.shape[1]
        return codes, errors

    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _vectors(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy(), np.cumsum(np.diff(column.offsets.to_numpy()))
    return np.split(flat, ends[:-1])


def limbs(number: int, count: int) -> list[int]:
    """Pieces of LIMB bits with the sign of the number, the lowest first; the last one takes what is left."""
    sign, rest, found = (-1 if number < 0 else 1), abs(number), []
    for _ in range(count - 1):
        found.append(sign * (rest & (1 << LIMB) - 1))
        rest >>= LIMB
    return [*found, sign * rest]


def _sums(shared, count: int):
    """Rows (part, entry, count, sums) of a task, the sums of each component in ``count`` limbs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: Codebooks = shared.value
        parts, entries, size = books.entries.shape
        held = np.zeros((parts, entries, size), books.entries.dtype)
        used = np.zeros((parts, entries), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = books.whole(_vectors(batch.column(0)))
            codes, _ = books.assigned(x)
            for p in range(parts):
                np.add.at(held[p], codes[:, p], x[:, p])
                used[p] += np.bincount(codes[:, p], minlength=entries)
        part, entry = np.nonzero(used)
        sums = [[piece for v in held[p, e].tolist() for piece in limbs(v, count)] for p, e in zip(part, entry)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(used[part, entry]), pa.array(sums, pa.list_(pa.int64()))],
            ["part", "entry", "count", "sums"],
        )

    return run


def _codes(shared, schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: Codebooks = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, errors = books.assigned(books.whole(_vectors(batch.column(2))))
            fit = [e if e < 1 << 63 else None for e in errors.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(codes.tolist(), pa.list_(pa.int32())), pa.array(fit, pa.int64())],
                [f.name for f in schema.fields],
            )

    return run


def usable(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``key``, ``label`` and ``vector`` (doubles) of the rows whose vector is there and finite throughout."""
    rows = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)))


def train(rows: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks for the usable rows; without rows none.

    They start as the vectors of the smallest keys (null keys last, equal keys in the order of their vectors), fewer if
    there are not as many rows. In each round every part goes to its nearest entry, and an entry that has parts
    becomes the floor of their mean.
    """
    spark = rows.sparkSession
    facts = rows.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width"), F.max(F.array_max(F.transform("vector", F.abs))).alias("top")
    ).first()
    if not facts.n:
        return None
    size = max(1, -(-facts.width // parts))
    top = int(facts.top or 0) * scale + scale
    # The largest scaled distance, and the largest sum of components.
    narrow = (1 << (size - 1).bit_length()) * size * parts * (2 * top) ** 2 < 1 << 62 and facts.n * top < 1 << 62
    books = Codebooks(np.zeros((parts, 0, size), np.int64 if narrow else object), scale)
    first = rows.orderBy(F.col("key").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    books.entries = books.whole([np.array(r.vector, float) for r in first]).transpose(1, 0, 2).copy()
    count = 1 if narrow else LIMBS
    places = [F.sum(F.col("sums")[i]) for i in range(size * count)]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)
        sums = rows.select("vector").mapInArrow(_sums(shared, count), "part int, entry int, count long, sums array<long>")
        found = sums.groupBy("part", "entry").agg(F.sum("count").alias("count"), F.array(*places).alias("sums")).collect()
        books = Codebooks(books.entries.copy(), scale)
        for r in found:
            total = [sum(v << LIMB * i for i, v in enumerate(r.sums[c * count : (c + 1) * count])) for c in range(size)]
            books.entries[r.part, r.entry] = [t // r["count"] for t in total]
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``key``, ``label``, ``codes`` (an entry for each part) and ``error`` of usable rows."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    kinds = [rows.schema[c].dataType.simpleString() for c in ("key", "label")]
    schema = rows.sparkSession.createDataFrame([], f"key {kinds[0]}, label {kinds[1]}, codes array<int>, error long").schema
    return rows.select("key", "label", "vector").mapInArrow(_codes(shared, schema), schema)


def decode(code: list[int], books: Codebooks) -> list[float]:
    """The vector a code stands for: the entries of its parts, as components of the original scale."""
    return [x / books.scale for p, e in enumerate(code) for x in books.entries[p, e].tolist()]


def compress(
    vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, Codebooks | None]:
    """``key``, ``label``, ``codes``, ``error`` and ``label_error`` of every usable row, and the codebooks.

    Rows whose vector is null or holds null or non-finite components are left out. Vectors shorter than the longest, or
    whose width no number of parts divides, count as padded with zeros; an empty vector is all zeros. ``label_error``
    is the sum of ``error`` over rows of equal labels, nulls together. Repeated rows and keys are rows like any other,
    null keys too. Components of any finite size are handled exactly; an error or a sum above a long is null. An empty
    table gives no rows and no codebooks. A very frequent label is one partial sum in each task, and the sums, as many
    as there are labels, are joined back, broadcast only if Spark has measured them to be small.
    """
    rows = written(usable(vectors, key, vector, label), "vectors")
    books = train(rows, parts=parts, entries=entries, rounds=rounds, scale=scale)
    if books is None:
        empty = rows.select("key", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"))
        return empty.withColumnRenamed("key", key).withColumn("label_error", F.col("error")), None
    coded = written(encode(rows, books), "codes")
    sums = coded.groupBy(F.col("label").alias("__label")).agg(
        F.when(F.count("error") == F.count(F.lit(1)), F.try_sum("error")).alias("label_error")
    )
    found = coded.join(sums, F.col("label").eqNullSafe(F.col("__label")), "left")
    return found.select(F.col("key").alias(key), "label", "codes", "error", "label_error"), books
