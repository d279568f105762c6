"""Periodic runs against a comparison at every lag."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np

import __spark_entry__ as entry
from llm_samples import DATA, ODD_TEXTS
from motorpool.llm import periodic_runs


def brute(x) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period."""
    x, found = np.asarray(x), {}
    for lag in range(1, len(x) // 2 + 1):
        edges = np.flatnonzero(np.concatenate(([True], x[lag:] != x[:-lag], [True])))
        for a, b in zip(edges.tolist(), edges[1:].tolist()):
            length = b - a - 1 + lag
            if length >= max(12, 2 * lag):
                found.setdefault((a, length), lag)
    return sorted(((a, n, p) for (a, n), p in found.items()), key=lambda r: (r[0], r[2]))


def of(x) -> list[tuple[int, int, int]]:
    return [(a, b - a, p) for a, b, p in periodic_runs.runs_of(np.array(x, np.int64)).tolist()]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_known_sequences():
    assert of([]) == of(range(40)) == of([5] * 11) == []
    assert of([5] * 12) == [(0, 12, 1)]
    assert of([1, 2] * 6) == [(0, 12, 2)]
    assert of([*range(50), *range(50)]) == [(0, 100, 50)]
    for x in (fibonacci(900), [0, 1] * 60 + [0] + [0, 1] * 60 + [0], [*range(300)] * 3, ([0] * 40 + [1]) * 9):
        assert of(x) == brute(x)


def test_touching_runs_of_a_short_period():
    """The repeated part of the longer run lies inside the shorter one, where no minimizer is a seed."""
    x = ([0, 1] * 80 + [0]) * 2
    assert (0, 322, 161) in of(x) and of(x) == brute(x)
    x = [0, 1, 2] * 70 + [0] + [0, 1, 2] * 90
    assert len(of(x)) > 20 and of(x) == brute(x)


def test_random_sequences():
    rng = random.Random(5)
    for turn in range(150):
        x: list[int] = []
        while len(x) < 500:
            root = [rng.randrange(rng.choice([2, 3, 60])) for _ in range(rng.choice([1, 2, 3, 7, 20, 45, 100]))]
            x += root * rng.randrange(1, 7)
            if rng.random() < 0.4:
                x[-1] = 99
        assert of(x[:500]) == brute(x[:500]), turn


def test_very_long_text():
    rng = random.Random(1)
    root = [rng.randrange(10**6) for _ in range(30_000)]
    assert of([-1, *root, *root, *root[:5000], -2]) == [(1, 65_000, 30_000)]


def test_texts_share_no_run():
    texts = [b"a b a b a b a b".split(), b"a b a b a b a b".split(), [], b"a b a b a b a b a b a b".split()]
    found, kept = periodic_runs.found_in(texts)
    assert found == [[], [], [], [(0, 12, 2)]]
    assert kept == [*texts[:3], [b"a", b"b"]]


def test_odd_rows(spark, odd):
    rows = periodic_runs.periodic_runs(odd).collect()
    assert len(rows) == odd.count()
    by_text = {t: r for t, r in zip(ODD_TEXTS, rows)}
    assert all(by_text[t].n_words == 0 and by_text[t].runs == [] and by_text[t].collapsed == "" for t in (None, "", " \n\t "))
    long = by_text["long " * 30000]
    assert [tuple(r) for r in long.runs] == [(0, 30000, 1)] and long.collapsed == "long"
    assert by_text[ODD_TEXTS[8]].n_words == len(ODD_TEXTS[8].encode().split())
    assert periodic_runs.periodic_runs(odd.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    rows = {r.doc_id: r for r in entry.queries()["op12_periodic_runs"](spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(rows) == len(docs)
    changed = 0
    for d in docs:
        words = (d.text or "").encode().split()
        n, h = len(words), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            changed += 1
        numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
        runs = brute([numbers[w] for w in words])
        gone = {i for a, length, p in runs for i in range(a + p, a + length)}
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        assert tuple(rows[d.doc_id]) == (
            d.doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join(f"{a},{length},{p}\n" for a, length, p in runs).encode()),
            sha(b" ".join(w for i, w in enumerate(words) if i not in gone)),
        )
    assert changed > 5


def test_query_survives_odd_rows(spark, odd, tmp_path):
    for i, df in enumerate((odd, odd.limit(0))):
        df.write.parquet(f"{tmp_path}/{i}/documents.parquet")
        got = entry.queries()["op12_periodic_runs"](spark, f"{tmp_path}/{i}")
        assert got.count() == df.count() and got.where("runs_sha256 IS NULL OR collapsed_sha256 IS NULL").count() == 0
