"""The shuffle is a permutation, reproducible, and deals evenly."""

from __future__ import annotations

import contextlib
import io
import zlib

import pytest
from llm_samples import DATA
from pyspark.sql import functions as F

from motorpool.llm import shards
from motorpool.llm.queries import op4_sharding


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 10, 24, 25, 997, 4096])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(shards.permuted(F.col("id"), n, 7)).collect()]
    assert sorted(got) == list(range(n))
    if n > 100:
        assert got != sorted(got)


def test_grid_is_just_large_enough():
    for n in [*range(1, 2000), 10**9, 10**12 + 7]:
        a, b = shards.grid(n)
        assert n <= a * b < n + max(a, b) and (n < 10 or (a * b - n) * 2 <= a * b)


def test_seeds_differ(spark):
    one, two = (spark.range(500).select(shards.permuted(F.col("id"), 500, s)).collect() for s in (1, 2))
    assert one != two


def check(rows, docs, n_shards):
    assert len(rows) == len(docs)
    want = sorted(((k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t in docs), key=repr)
    assert sorted(((r[0], r[1], r[2]) for r in rows), key=repr) == want
    slots = {}
    for r in rows:
        assert r.law == "rows" and r.grown_shard is None
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(s, [])) for s in range(n_shards)]
    assert max(counts) - min(counts) <= 1


def test_odd_rows(spark, odd):
    docs = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    check(shards.shard(odd, 4).collect(), docs, 4)
    assert shards.shard(odd.limit(0), 4).count() == 0


def test_one_key_and_one_text_everywhere(spark):
    df = spark.range(300).selectExpr("cast(null as long) as doc_id", "'same' as text")
    check(shards.shard(df, 7).collect(), [(None, "same")] * 300, 7)


def test_partitions_do_not_matter(spark):
    df = spark.range(500).selectExpr("id * 3 as doc_id", "concat('t', id % 50) as text")
    one, two = (sorted(map(tuple, shards.shard(d, 24).collect())) for d in (df.coalesce(1), df.repartition(7)))
    assert one == two


def test_query_is_native_and_whole(spark):
    df = op4_sharding(spark, DATA)
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        df.explain()
    assert "Python" not in shown.getvalue() and "Arrow" not in shown.getvalue()
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    check(df.collect(), docs, 24)
