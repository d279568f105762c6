"""Benchmark passages against a plain edit distance."""

from __future__ import annotations

import random

import pytest

from motorpool.llm import leaks as L
from motorpool.llm.queries import op8_decontamination
from llm_samples import DATA, ODD_TEXTS

ITEM = "What is the capital of the country that borders three seas and has two great rivers?"


def least_edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_against_plain_edit_distance():
    draw = random.Random(3)
    items = [(i, "".join(draw.choice("abcde ") for _ in range(draw.randint(40, 90)))) for i in range(12)]
    index, positives = L.index(items), 0
    for _ in range(60):
        texts = []
        for _ in range(3):
            signs = list(draw.choice(items)[1])
            for _ in range(draw.randint(0, 9)):
                p, what = draw.randrange(len(signs)), draw.random()
                if what < 0.33:
                    signs[p] = draw.choice("abcde")
                elif what < 0.66:
                    signs.insert(p, draw.choice("abcde"))
                else:
                    signs.pop(p)
            pad = ["".join(draw.choice("abcde ") for _ in range(draw.randint(0, 60))) for _ in range(2)]
            texts.append(f"{pad[0]} {''.join(signs)} {pad[1]}")
        want = {
            (t, index.ids[i])
            for t, text in enumerate(texts)
            for i, code in enumerate(index.codes)
            if least_edits(code.tolist(), L.plain([text]).codes[:-1].tolist()) <= index.budget[i]
        }
        positives += len(want)
        assert {(m[0], index.ids[m[1]]) for m in L.matches(texts, index)} == want
    assert positives > 50


@pytest.mark.parametrize(
    "text, edits",
    [
        (ITEM, 0),
        (f"before {ITEM} after", 0),
        (ITEM.upper(), 0),
        ("!!".join(ITEM.split(" ")), 0),
        (ITEM.replace("capital", "kapital"), 1),
        (ITEM[3:], 3),
        (ITEM.replace("three seas", "four lakes"), None),
        (ITEM[: len(ITEM) // 2], None),
        ("", None),
    ],
)
def test_one_item(text, edits):
    found = L.matches([text], L.index([(1, ITEM)]))
    assert [m[4] for m in found] == ([] if edits is None else [edits])


def test_places_are_in_code_points_of_the_text():
    text = f"é😀   {ITEM.upper()}!! end"
    ((_, _, start, end, _),) = L.matches([text], L.index([(1, ITEM)]))
    assert text[start:end] == ITEM.upper().rstrip("?")


def test_sharp_s_and_its_upper_case():
    item = "Die Straße ist heiß und groß, und der Fluß fließt an der Straße vorbei bis zum Schluß."
    assert L.matches([item.upper()], L.index([(1, item)]))[0][4] == 0


def test_every_place_and_every_item():
    index = L.index([(1, ITEM), (2, ITEM), (3, "short"), (4, "")])
    found = L.matches([f"{ITEM} and again {ITEM}", ITEM], index)
    assert [(m[0], index.ids[m[1]]) for m in found] == [(0, 1), (0, 1), (0, 2), (0, 2), (1, 1), (1, 2)]


def test_short_items_are_found_exactly_and_on_borders():
    index = L.index([(1, "What is DNA?"), (2, "who is it"), (3, "光合作用是什么"), (4, "a b c"), (5, "is it"), (6, "What is DNA?"), (7, "?!")])
    texts = ["Q: WHAT is -- DNA! what is dna", "what is dnas, somewhat is dna", "请问光合作用是什么意思", "who is", "it", "ba b c; a b c", "", "is it"]
    found = [(t, index.ids[i], texts[t][a:b], k) for t, i, a, b, k in L.matches(texts, index)]
    assert sorted(found) == [
        (0, 1, "WHAT is -- DNA", 0), (0, 1, "what is dna", 0), (0, 6, "WHAT is -- DNA", 0), (0, 6, "what is dna", 0),
        (2, 3, "光合作用是什么", 0), (5, 4, "a b c", 0), (7, 5, "is it", 0),
    ]
    both = L.index([(1, ITEM), (2, "three seas and has")])
    assert {(both.ids[m[1]], m[4]) for m in L.matches([ITEM], both)} == {(1, 0), (2, 0)}


def test_accents_composed_or_not():
    import unicodedata

    item = "Où est né l'élève dont le frère a gagné à Besançon près de la forêt?"
    index = L.index([(1, item), (2, "さがしています"), (3, "대한민국의 수도는 어디입니까 그리고 왜 그렇습니까 하고 물었다 그는")])
    for form in ("NFC", "NFD"):
        text = unicodedata.normalize(form, f"Dit-il: {item} Oui.")
        assert [(m[1], m[4], text[m[2] : m[3]]) for m in L.matches([text], index)] == [(0, 0, unicodedata.normalize(form, item[:-1]))]
    assert L.matches([unicodedata.normalize("NFD", "「さがしています」")], index)
    assert L.matches(["대한민국의 수도는 어디입니까 그리고 왜 그렇습니까 하고 물었다 그는"], index)


def test_every_place_of_a_repetitive_item():
    item = "ab cd " * 30
    for text, n in ((f"{item}-- {item}", 2), (f"{item} {'zz ' * 300} {item}", 2), (f"{item * 3}", 3), (f"x {item} y {item[:-30]} z {item}", 2)):
        found = L.matches([text], L.index([(1, item)]))
        assert len(found) == n and all(a[3] <= b[2] for a, b in zip(found, found[1:])), text


def test_documents_with_a_short_item_go(spark):
    bench = spark.createDataFrame([(1, "What is DNA?")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so what is DNA, then"), (2, "what is RNA"), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in L.leaks(docs, bench).collect()] == [(1, 1, 3, 14, 0)]
    assert {r.doc_id for r in L.without_leaks(docs, bench).collect()} == {2, 3}


def test_repetitive_items():
    items = [(1, "ab " * 40), (2, "x" * 5000), (3, "ha" * 30 + "no " + "ha" * 30)]
    index = L.index(items)
    assert len(index.repetitive) == 3
    texts = ["ab " * 38, "ab " * 20, "zz " * 40 + "ab " * 40 + "zz", "x" * 5000, "x" * 4000, "ha" * 30 + "n " + "ha" * 30, "ha" * 90, "xab" * 100]
    want = set()
    for t, text in enumerate(texts):
        code = L.plain([text]).codes[:-1].tolist()
        for i in range(3):
            if len(index.codes[i]) < 1000 and least_edits(index.codes[i].tolist(), code) <= index.budget[i]:
                want.add((t, index.ids[i]))
    assert {(m[0], index.ids[m[1]]) for m in L.matches(texts, index)} == want | {(3, 2)}


def test_postings_in_several_portions(monkeypatch):
    index = L.index([(i, f"{ITEM} part {i}") for i in range(20)])
    texts = [f"so {ITEM} part {i} and" for i in range(20)]
    want = L.matches(texts, index)
    monkeypatch.setattr(L, "POSTINGS", 50)
    assert L.matches(texts, index) == want and len(want) >= 20


def test_odd_rows(spark, odd):
    items = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(50, ITEM), (50, ITEM), (None, ITEM)]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id")
    got = L.leaks(odd, bench)
    assert got.columns == ["doc_id", "item_id", "start", "end", "edits"]
    prose = {(r.doc_id, r.item_id) for r in got.collect() if r.item_id in (5, 6, 7)}
    assert prose == {(d, i) for d in (5, 6, 7) for i in (5, 6, 7)}
    assert L.leaks(odd, bench.limit(0)).count() == 0 == L.leaks(odd.limit(0), bench).count()
    kept = L.without_leaks(odd, bench.where("item_id = 5"))
    assert kept.columns == odd.columns and {5, 6, 7}.isdisjoint(r.doc_id for r in kept.where("lang = 'en' and n_chars = 6").collect())
    assert kept.count() == odd.count() - 4


def test_benchmark_in_several_portions(spark, monkeypatch):
    items = [(i, f"{ITEM} number {i} of the whole long list") for i in range(6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(10 + i, t) for i, t in items], "doc_id long, text string")
    monkeypatch.setattr(L, "ITEM_BYTES", 150)
    got = {(r.doc_id - 10, r.item_id) for r in L.leaks(docs, bench).collect() if not r.edits}
    assert got == {(i, i) for i in range(6)}
    assert L.without_leaks(docs, bench).count() == 0


def test_query_finds_all_plain_copies(spark):
    found = {(r.doc_id, r.item_id) for r in op8_decontamination(spark, DATA).collect()}
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet").collect()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    want = {(d.doc_id, b.item_id) for d in docs for b in bench if b.text in d.text}
    assert want <= found
    plain = {b.item_id: bytes(L.plain([b.text]).codes[:-2].tobytes()) for b in bench}
    of = {d.doc_id: d.text for d in docs}
    assert all(plain[i] in L.plain([of[d]]).codes.tobytes() for d, i in found - want)
