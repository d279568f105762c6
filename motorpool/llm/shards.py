"""A reproducible shuffle into shards, by a keyed permutation of global row numbers.

Rows get a global number from the contents of the row. A Feistel network over a grid just larger than the number of
rows permutes these numbers; places outside the table are walked on until one inside is met. Shard and slot of a row
are then plain arithmetic on its place, so they can also be computed backwards. DataFrame functions only.
"""

from __future__ import annotations

from math import ceil, isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROUNDS = 6
# Steps a walk may take. Each stays outside with a chance of at most 1 in 2; a row that needs more fails the job.
WALK = 64
# Rows numbered in one window partition, on average, and window partitions at most (16 bytes each when broadcast).
ROWS_PER_BUCKET = 200_000
MOST_BUCKETS = 65_536


def grid(n: int) -> tuple[int, int]:
    """Sides of the grid whose cells are permuted: their product is at least n and exceeds it by less than a side."""
    a = max(1, isqrt(max(n - 1, 0)) + 1)
    return a, max(1, ceil(n / a))


def permuted(place: Column, n: int, seed: int) -> Column:
    """The place of row number ``place`` (0 to n - 1) after the shuffle: a permutation of 0 to n - 1."""
    a, b = grid(n)
    sides = F.array(F.lit(a).cast("long"), F.lit(b).cast("long"))

    def one_round(state: Column, i: Column) -> Column:
        # (left, right) -> (right, left + hash of right), the sum within the side that left lives on
        side = F.element_at(sides, (i % 2 + 1).cast("int"))
        mixed = F.pmod(state["left"] + F.pmod(F.xxhash64(state["right"], i, F.lit(seed).cast("long")), side), side)
        return F.struct(state["right"].alias("left"), mixed.alias("right"))

    def once(x: Column) -> Column:
        start = F.struct((x % F.lit(a).cast("long")).alias("left"), F.floor(x / F.lit(a)).cast("long").alias("right"))
        rounds = F.transform(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), lambda i: i.cast("long"))
        # ROUNDS is even, so left is back on the side of length a
        return F.aggregate(rounds, start, one_round, lambda s: s["right"] * a + s["left"])

    # Integer division in floating point is exact below 2**53 places.
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)), once(place), lambda x, _: F.when(x < n, x).otherwise(once(x))
    )
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("the walk left the table; take another seed")).cast("long"))


def row_numbers(df: DataFrame, by: list[str], buckets: int, name: str = "row_number") -> DataFrame:
    """Number all rows from 0 without gaps, in an order that depends on the columns ``by`` alone.

    Rows fall into ``buckets`` by hash and are ordered by value inside each; the counts of the buckets before give the
    offset. Rows equal in all of ``by`` are interchangeable.
    """
    spread = df.withColumn("__bucket", F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int"))
    sizes = spread.groupBy("__bucket").count()
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__bucket").orderBy(*[F.col(c).asc_nulls_first() for c in by])
    numbered = spread.withColumn("__inside", F.row_number().over(inside))
    joined = numbered.join(F.broadcast(offsets), "__bucket")
    return joined.withColumn(name, F.col("__offset") + F.col("__inside") - 1).drop("__bucket", "__offset", "__inside")


def shard(
    docs: DataFrame, shards: int = 24, *, key: str = "doc_id", text: str = "text", seed: int = 7
) -> DataFrame:
    """Deal all rows into ``shards`` by the law "rows": sizes in rows differ by one at most.

    Returns ``key``, ``size`` (UTF-8 bytes of the text and 8 more), ``text_crc32``, ``law``, ``shard``, ``slot`` (0, 1,
    ... within the shard without gaps) and ``grown_shard`` (null: under this law another shard moves rows everywhere).
    The result depends on the rows, the number of shards and the seed alone, not on files or partitions. Null texts
    have size 8 and the checksum of the empty text; null and repeated keys are rows like any other; an empty table
    gives no rows. Only the narrow columns are shuffled.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    narrow = docs.select(
        F.col(key),
        (F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
    )
    n = docs.select(F.count(F.lit(1))).first()[0]
    buckets = min(MOST_BUCKETS, max(1, ceil(n / ROWS_PER_BUCKET)) * 16)
    numbered = row_numbers(narrow, [key, "text_crc32", "size"], buckets)
    place = permuted(F.col("row_number"), max(n, 1), seed)
    return numbered.withColumn("__place", place).select(
        key,
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("__place") % shards).cast("int").alias("shard"),
        F.floor(F.col("__place") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
