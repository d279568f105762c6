"""Integer codebooks against plain squared distances."""

from __future__ import annotations

import hashlib
from math import floor, inf, nan

import numpy as np
import pytest

import __spark_entry__ as entry
from llm_samples import DATA
from motorpool.llm import vector_codes

SHAPE = "vec_id long, embedding array<double>, label int, code string"


def brute(rows, entries=256, rounds=4, parts=4):
    """Rows (vec_id, codes, error, label_error) and the codebooks, with plain whole numbers."""
    kept = [r for r in rows if r[1] is not None and all(v is not None and abs(v) < inf for v in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    size = max(1, -(-max((len(r[1]) for r in kept), default=0) // parts))
    whole = [[floor(v * 1024) if abs(v) < 1e200 else int(v) * 1024 for v in r[1]] + [0] * (parts * size - len(r[1])) for r in kept]
    cut = [[w[p * size : p * size + size] for p in range(parts)] for w in whole]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def assigned():
        far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
        return [[min((far(c[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        own = assigned()
        for p in range(parts):
            for k in range(len(books[p])):
                if mine := [c[p] for c, o in zip(cut, own) if o[p][1] == k]:
                    books[p][k] = [sum(v) // len(mine) for v in zip(*mine)]
    found = [(r, [k for _, k in o], sum(d for d, _ in o)) for r, o in zip(kept, assigned())]
    sums = {}
    for r, _, e in found:
        sums[r[2]] = sums.get(r[2], 0) + e
    return [(r[0], c, e, sums[r[2]]) for r, c, e in found], books


def by_key(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0))


def test_sequency_counts_sign_changes():
    for n in (1, 2, 4, 16, 64):
        rows = vector_codes.transformed(np.eye(n, dtype=np.int64)).T
        assert [int((np.diff(r) != 0).sum()) for r in rows] == list(range(n))
        assert (rows @ rows.T == n * np.eye(n)).all()


def test_nearest_is_exact_with_ties():
    rng = np.random.default_rng(4)
    for kind in (np.int64, object):
        for width in (1, 3, 5, 16):
            x, e = (rng.integers(-3, 4, (k, width)).astype(kind) for k in (300, 40))
            far = ((x[:, None] - e[None]) ** 2).sum(axis=2)
            own, least = vector_codes.nearest(vector_codes.transformed(x), vector_codes.transformed(e))
            size = vector_codes.transformed(e).shape[1]
            assert own.tolist() == far.argmin(axis=1).tolist() and (least == size * far.min(axis=1)).all()


def test_limbs():
    for v in (0, 1, -1, 1 << 29, -(1 << 30), 12345678901234567890, -(3**600)):
        pieces = vector_codes.limbs(v, vector_codes.LIMBS)
        assert sum(p << 30 * i for i, p in enumerate(pieces)) == v and all(abs(p) < 1 << 31 for p in pieces)


@pytest.mark.parametrize("large", [1.0, 1e6, 1e300])
def test_against_brute_force(spark, large):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=8) * large).tolist(), int(i % 3) if i % 7 else None, "c") for i in range(60)]
    rows += [(3, rows[3][1], 1, "c"), (None, [0.5] * 8, 1, "c"), (70, [], 2, "c"), (71, [1.0] * 3, 2, "c"), (72, [0.0] * 8, 2, "c")]
    rows += [(80, None, 1, "c"), (81, [nan] * 8, 1, "c"), (82, [inf] + [0.0] * 7, 1, "c"), (83, [None] * 8, 1, "c"), (84, [1.0, None], None, "c")]
    got, books = vector_codes.compress(spark.createDataFrame(rows, SHAPE).repartition(5), entries=16)
    want, plain = brute(rows, 16)
    assert books.entries.tolist() == plain
    fit = lambda v: v if v < 1 << 63 else None
    assert by_key([(r.vec_id, r.codes, r.error, r.label_error) for r in got.collect()]) == by_key(
        [(k, c, fit(e), fit(s)) for k, c, e, s in want]
    )
    assert (books.entries.dtype == object) == (large > 1e4)


def test_few_rows_and_none(spark):
    one = spark.createDataFrame([(1, [0.25, -0.001, 0.0, 0.0], 1, "c")], SHAPE)
    got, books = vector_codes.compress(one)
    assert [tuple(r) for r in got.collect()] == [(1, 1, [0, 0, 0, 0], 0, 0)]
    assert vector_codes.decode([0, 0, 0, 0], books) == [0.25, -2 / 1024, 0.0, 0.0]
    got, books = vector_codes.compress(one.limit(0))
    assert books is None and got.columns == ["vec_id", "label", "codes", "error", "label_error"] and got.count() == 0


def test_query(spark):
    rows = entry.queries()["op13_vector_codes"](spark, DATA).collect()
    table = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    want, books = brute([tuple(r) for r in table])
    sha = hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()
    assert sorted(map(tuple, rows)) == [(k, bytes(c).hex(), e, s, sha) for k, c, e, s in want]
