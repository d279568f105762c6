"""Packed sequences: limits, whole documents, and no padding."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from llm_samples import DATA, ODD_TEXTS, TOKENIZER
from motorpool.llm import packing
from motorpool.llm.packing import Limits, Piece


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


def checked(rows, limits=Limits(), free=None):
    """Pieces cover each document once, sequences keep the limits and need no padding. Returns their lengths."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r[0], []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces in by_doc.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == pieces[0].doc_tokens
    lengths = []
    for pieces in by_sequence.values():
        at = loss = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
            loss += max(0, r.start + r.length - max(r.start + 1, (free or {}).get(r[0], 0)))
        assert at <= limits.tokens and len(pieces) <= limits.segments and loss <= limits.loss
        assert at == limits.tokens or at & (at - 1) == 0
        lengths.append(at)
    return lengths


def test_ids_are_those_of_the_library(library):
    of = packing.ids_of(TOKENIZER).of
    rng = random.Random(3)
    signs = "abcXYZ  \n\t'é漢😀0189.,;<|>_-͸‍\x00\U0001fae9"
    texts = [t for t in ODD_TEXTS if t] + ["".join(rng.choices(signs, k=rng.randrange(60))) for _ in range(1500)]
    for t in texts:
        assert of(t).tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_pieces():
    p = Piece(0, 0, 10, 4)
    assert (p.loss(), p.loss(3), p.most(8, 100), p.most(8, 2), p.most(8, 0)) == (6, 0, 8, 6, 4)
    a, b = p.cut(6)
    assert (a.loss(), b.loss(), b.start, b.length) == (2, 3, 6, 4)
    assert Piece(0, 0, 5, 0).loss() == 4 and Piece(0, 7, 1, 0).loss() == 0


@pytest.mark.parametrize("limits", [Limits(64, 8, 64), Limits(64, 8, 20), Limits(64, 1, 64), Limits(64, 3, 1), Limits(1, 1, 1), Limits(100, 50, 0)])
def test_all_three_limits(limits):
    rng = random.Random(limits.loss)
    for sizes in ([1] * 500, [63, 65] * 40, [rng.randrange(1, 200) for _ in range(400)], [1000], []):
        pool, items = packing.Pool(limits), [(i, n, rng.choice([0, n // 2, n])) for i, n in enumerate(sizes)]
        made = [*packing.packed(iter(items), limits, 300, pool), *packing.packed(iter(()), limits, 0, pool)]
        spans = sorted((p.item, p.start, p.length) for s in made for p in s)
        assert [i for i, *_ in items] == sorted({i for i, *_ in spans})
        for i, n, _ in items:
            mine = [(s, k) for j, s, k in spans if j == i]
            assert [s for s, _ in mine] == [sum(k for _, k in mine[:x]) for x in range(len(mine))] and sum(k for _, k in mine) == n
        for s in made:
            total = sum(p.length for p in s)
            assert total <= limits.tokens and len(s) <= limits.segments and sum(p.loss() for p in s) <= limits.loss
            assert total == limits.tokens or total & (total - 1) == 0


def test_the_piece_most_along_what_is_left_comes_first():
    pool = packing.Pool(Limits(100, 4, 100))
    for i, n in enumerate((60, 50, 40, 30, 10)):
        list(pool.add(Piece(i, 0, n, 0)))
    assert [p.length for p in pool.sequence()] == [60, 40]
    assert sorted(p.length for p in pool.sequence()) == [10, 14, 50] or pool.tokens < 90


def test_few_pieces_are_cut():
    rng = random.Random(9)
    limits, sizes = Limits(), [rng.randrange(20, 700) for _ in range(3000)]
    pool = packing.Pool(limits)
    items = [(i, n, 0) for i, n in enumerate(sizes)]
    made = [*packing.packed(iter(items), limits, packing.RESERVE, pool), *packing.packed(iter(()), limits, 0, pool)]
    assert sum(len(s) for s in made) < 1.1 * len(sizes) and len(made) <= sum(sizes) / 1024 + 10


def test_query(spark, library):
    rows = entry.queries()["op11_packing"](spark, DATA).collect()
    lengths = checked(rows)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(docs)
    ids = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in docs.items()}
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    assert sum(lengths) == sum(map(len, ids.values())) and lengths.count(1024) > 0.8 * len(lengths)


def test_prompts_bear_no_loss(spark, library):
    rows = [(i, "ask " * (i % 50), "answer it " * (i % 90)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, prompt string, text string")
    limits = Limits(256, 16, 100)
    got = packing.pack(df, TOKENIZER, limits, prompt="prompt", ids=True).collect()
    free = {i: len(library.encode(p, add_special_tokens=False).ids) for i, p, _ in rows}
    checked(got, limits, free)
    whole = {}
    for r in sorted(got, key=lambda r: r.start):
        whole.setdefault(r.doc_id, []).extend(r.ids)
    for i, p, t in rows:
        parts = (library.encode(s, add_special_tokens=False).ids for s in (p, t))
        assert whole[i] == [*(x for part in parts for x in part), 0]


def test_odd_rows(spark, odd):
    df = odd.selectExpr("struct(monotonically_increasing_id() as i, text) as doc_id", "text", "'x' as start", "1 as length")
    rows = packing.pack(df, TOKENIZER).collect()
    assert len({r.doc_id for r in rows}) == df.count() and checked(rows)
    none = [r for r in rows if not (r.doc_id.text or "")]
    assert none and all((r.start, r.length, r.doc_tokens) == (0, 1, 1) for r in none)
    assert packing.pack(odd, TOKENIZER).groupBy().sum("length").first()[0] == sum(r.length for r in rows)
    assert packing.pack(odd.limit(0), TOKENIZER).count() == 0
    assert packing.pack(odd.where("text IS NULL"), TOKENIZER, end=None).count() == 0
