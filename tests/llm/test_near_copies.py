"""Joins of near copies, texts and vectors, against comparing all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from motorpool.llm import shingle_join as J
from motorpool.llm import vector_dedup as V
from motorpool.llm.graph import components
from motorpool.llm.queries import op3_embedding_dedup, op10_shingle_join
from llm_samples import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def set_of(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def plain_components(docs):
    """Rows (doc_id, n_shingles, component_id, n_links) by comparing all pairs."""
    sets = {i: set_of(t) for i, t in docs}
    union, ids, links = Union(sets), sorted(sets), dict.fromkeys(sets, 0)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                union.join(i, j)
                links[i] += 1
                links[j] += 1
    return sorted((i, len(sets[i]), union.root(i), links[i]) for i in ids)


def check(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, J.near_copies(df).collect())) == plain_components(docs)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (9, 8), (8, 7), (20, 10), (10, 30), (30, 31), (31, 5), (2, 1)]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, **dict.fromkeys((5, 10, 20, 30, 31), 5)}
    path = random.Random(1).sample(range(300), 300)
    got = components(spark.createDataFrame(list(zip(path, path[1:])), "a long, b long")).collect()
    assert len(got) == 300 and {r.component for r in got} == {0}
    star = spark.createDataFrame([(1000, i) for i in range(500)], "a long, b long")
    assert {r.component for r in components(star).collect()} == {0}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([(4, 4)], "a long, b long")).count() == 0


def words(draw, n, pool=5000):
    return [f"w{draw.randrange(pool)}" for _ in range(n)]


def edited(draw, base, edits):
    out = list(base)
    for _ in range(edits):
        out[draw.randrange(len(out))] = f"e{draw.randrange(10**6)}"
    return out


def test_near_copies_chains_and_sizes(spark):
    draw, docs = random.Random(3), []
    for size in (1, 3, 4, 5, 6, 9, 14, 60, 400):
        base = words(draw, size)
        for edits in (0, 0, 1, 2, 3, size // 20, size // 10):
            docs.append(edited(draw, base, edits))
        chain = base
        for _ in range(5):
            chain = edited(draw, chain, max(1, size // 45))
            docs.append(chain)
        docs += [base + words(draw, size // 5), base + words(draw, size // 4 + 1), base[: size * 4 // 5 + 1]]
    check(spark, [(i, " ".join(d)) for i, d in enumerate(docs)])


def test_shared_passages_and_large_groups(spark, monkeypatch):
    """Passages many documents share, a large group of near copies, and documents that only consist of shared lines."""
    monkeypatch.setattr(J, "LONG", 6)
    monkeypatch.setattr(J, "BLOCK", 8)
    draw = random.Random(5)
    passage, group = words(draw, 40), words(draw, 120)
    lines = [words(draw, 12) for _ in range(12)]
    docs = [words(draw, draw.randint(20, 200)) + passage + words(draw, 20) for _ in range(60)]
    docs += [edited(draw, group, draw.randint(0, 6)) for _ in range(80)]
    docs += [sum(draw.sample(lines, draw.randint(5, 12)), []) for _ in range(60)]
    docs += [sum(lines[k : k + 9], []) + words(draw, draw.randint(0, 25)) for k in (0, 1, 2, 3) for _ in range(8)]
    check(spark, [(i, " ".join(d)) for i, d in enumerate(docs)])


def test_long_lists_found_inside_one_task(spark, monkeypatch):
    monkeypatch.setattr(J, "LONG", 4)
    draw = random.Random(8)
    group, lines = words(draw, 60), [words(draw, 8) for _ in range(10)]
    docs = [edited(draw, group, draw.randint(0, 9)) for _ in range(50)]
    docs += [sum(draw.sample(lines, draw.randint(4, 10)), []) for _ in range(50)]
    texts = [(i, " ".join(d)) for i, d in enumerate(docs)]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    assert sorted(map(tuple, J.near_copies(df).collect())) == plain_components(texts)


def test_a_group_of_loosely_near_copies_never_becomes_pairs(spark, monkeypatch):
    """Copies further apart than the threshold fall into many components that share their long lists."""
    monkeypatch.setattr(J, "LONG", 6)
    monkeypatch.setattr(J, "LEADERS", 1)
    draw, listed, verified = random.Random(11), [], J._Join.verified
    monkeypatch.setattr(J._Join, "verified", lambda self, pairs: listed.append(pairs.count()) or verified(self, pairs))
    group = words(draw, 120)
    texts = [(i, " ".join(edited(draw, group, draw.randint(2, 3)))) for i in range(200)]
    df, expected = spark.createDataFrame(texts, "doc_id long, text string").repartition(4), plain_components(texts)
    assert sorted(map(tuple, J.near_copies(df).collect())) == expected
    assert sum(listed) < 5 * len(texts)
    del listed[:]
    assert sorted(r.doc_id for r in J.one_of_each(df).collect()) == sorted({r[2] for r in expected})
    assert sum(listed) < 5 * len(texts)


def test_forest_connects_with_as_few_edges_as_it_takes():
    draw = np.random.default_rng(7)
    for n, m in [(1, 0), (2, 5), (40, 30), (300, 4000)]:
        forest, union, kept, edges = J.Forest(n), Union(range(n)), Union(range(n)), 0
        for _ in range(4):
            a, b = draw.integers(0, n, (2, m))
            for x, y in zip(a.tolist(), b.tolist()):
                union.join(x, y)
            used = forest.grow(a, b)
            edges += len(used)
            for x, y in zip(a[used].tolist(), b[used].tolist()):
                kept.join(x, y)
        roots = [union.root(i) for i in range(n)]
        assert [kept.root(i) for i in range(n)] == roots == forest.root.tolist()
        assert edges == n - len(set(roots))


def test_words_as_the_contract_has_them(spark):
    check(spark, [(1, "A b\tc\x0bd\x0ce"), (2, "a B c D E"), (3, "a b c d e"), (4, "É b c d e"), (5, "é b c d e"), (6, "a b"), (7, "A  B "), (8, ""), (9, " \n"), (10, "\x1ca")])


def test_overlap_bound_never_lies_below():
    draw = np.random.default_rng(3)
    for n, m, both in [(10, 12, 8), (500, 700, 300), (5000, 100, 60), (3000, 3000, 2900)]:
        pool = draw.integers(0, 2**63, n + m, dtype=np.uint64)
        x, y = pool[:n], np.concatenate((pool[:both], pool[n : n + m - both]))
        assert J.overlap_bound(J.bucket_counts(x), J.bucket_counts(y)) >= both
    assert J.bucket_counts(np.zeros(300, np.uint64)) is None and J.overlap_bound(None, b"") > 10**9


def test_odd_rows(spark, odd):
    got = J.near_copies(odd)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "n_links"] and got.count() == odd.count()
    rows = [tuple(r)[:3] for r in got.collect()]
    assert {r[2] for r in rows if r[0] in (5, 7)} == {5}
    assert (None, 1, None) in rows and (None, 0, None) in rows
    assert J.near_copies(odd.limit(0)).count() == 0
    kept = J.one_of_each(odd)
    assert kept.columns == odd.columns
    assert kept.count() == odd.count() - 3  # of four copies of the prose one stays
    assert kept.where("doc_id = 5").count() == 1
    assert J.one_of_each(odd.limit(0)).count() == 0


def test_one_of_each_by_shuffling_too(spark, odd, monkeypatch):
    want = sorted(map(repr, J.one_of_each(odd).drop("n_chars").collect()))
    monkeypatch.setattr(J, "BROADCAST_ROWS", 0)
    assert sorted(map(repr, J.one_of_each(odd).drop("n_chars").collect())) == want


def test_query_against_all_pairs(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op10_shingle_join(spark, DATA).collect())) == plain_components(docs)


@pytest.mark.parametrize("block, elements", [(2048, 1 << 21), (8, 1 << 21), (2048, 400)])
def test_every_link_is_counted(spark, monkeypatch, block, elements):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "ELEMENTS", elements)
    draw = random.Random(9)
    group, small = words(draw, 120), words(draw, 9)
    docs = [edited(draw, group, draw.randint(0, 4))[: draw.randint(90, 120)] for _ in range(60)]
    docs += [small, small, small, small + ["x"], [], [], *[words(draw, 30) for _ in range(5)]]
    texts = [(i, " ".join(d)) for i, d in enumerate(docs)]
    want = plain_components(texts)
    got = J.near_copies(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == want and sum(r[3] for r in want) > 500


def test_merged_lists_count_what_sets_share():
    draw = np.random.default_rng(5)
    core = np.unique(draw.integers(-(2**62), 2**62, 120))
    sets = [np.unique(np.concatenate((draw.permutation(core)[: draw.integers(60, 121)], draw.integers(0, 300, draw.integers(0, 60))))) for _ in range(70)]
    for block in (sets[:1], sets[:2], sets[:50], sets[40:]):
        merger = J.Merger(block)
        for x in sets:
            assert merger.shared(x).tolist() == [len(np.intersect1d(x, y)) for y in block]


def test_whole_groups():
    import pyarrow as pa

    draw = random.Random(2)
    values = sorted(draw.randrange(12) for _ in range(200))
    batches = [pa.RecordBatch.from_arrays([pa.array(values[i : i + 7]), pa.array(range(i, min(200, i + 7)))], ["a", "b"]) for i in range(0, 200, 7)]
    tables = list(J.whole_groups(iter(batches), 1))
    assert [v for t in tables for v in t.column(0).to_pylist()] == values and len(tables) > 5
    ends = [(t.column(0)[0].as_py(), t.column(0)[-1].as_py()) for t in tables]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


def test_links_of_odd_rows(spark, odd):
    got = J.near_copies(odd).collect()
    assert {r.n_links for r in got if r.component_id == 5} == {3}


# --- vectors -----------------------------------------------------------------------------------


def plain_links(rows, least=0.93):
    usable = [
        (i, np.array(v, float), label)
        for i, v, label in rows
        if label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    links, union = {r[0]: 0 for r in rows}, Union(r[0] for r in rows)
    for n, (i, v, a) in enumerate(usable):
        for j, w, b in usable[n + 1 :]:
            if a == b and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= least:
                links[i] += 1
                links[j] += 1
                union.join(i, j)
    return sorted((i, links[i], union.root(i), union.root(i) == i) for i in links)


def clustered(n, width, seed, labels=3):
    draw, rows = np.random.default_rng(seed), []
    while len(rows) < n:
        base = draw.normal(size=width)
        for _ in range(int(draw.integers(1, 9))):
            rows.append((len(rows), (base + draw.normal(size=width) * draw.uniform(0, 0.5)).tolist(), int(draw.integers(labels))))
    return rows[:n]


@pytest.mark.parametrize("cell, block, sample", [(1024, 4096, 20000), (20, 7, 20000), (10, 5, 60)])
def test_vectors_against_all_pairs(spark, monkeypatch, cell, block, sample):
    monkeypatch.setattr(V, "CELL", cell)
    monkeypatch.setattr(V, "BLOCK", block)
    monkeypatch.setattr(V, "SAMPLE", sample)
    rows = clustered(600, 12, 7)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = plain_links(rows)
    assert sum(w[1] for w in want) > 100
    assert sorted(map(tuple, V.near_vectors(df).collect())) == want


def test_odd_vectors(spark):
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [], 1),
        (8, [1.0, None], 1), (9, [float("nan"), 1.0], 1), (10, [float("inf"), 1.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [-1.0, 0.0], 1),
        (13, [1.0, 0.01], 1), (14, [1e-200, 0.0], 1), (15, [1.7e308, 1e307], 1), (16, [-0.0, 1.0], 2), (17, [0.0, 1.0], 2), (18, [3.0], 5),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as id", "2 as key", "3 as vector")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in V.near_vectors(df).collect()}
    linked = (1, 2, 13, 14, 15)
    assert all(got[i] == (4, 1, i == 1) for i in linked)
    assert got[16] == (1, 16, True) and got[17] == (1, 16, False)
    assert all(got[i] == (0, i, True) for i in got if i not in (*linked, 16, 17))
    assert V.near_vectors(df.limit(0)).count() == 0


def test_one_vector_everywhere(spark):
    rows = [(i, [1.0, 2.0, 3.0], 1) for i in range(200)] + [(None, [1.0, 2.0, 3.0], 1)]
    got = V.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(200, 0)}
    assert sum(r.kept for r in got) == 1


def test_vector_query_against_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, op3_embedding_dedup(spark, DATA).collect())) == plain_links(rows)
