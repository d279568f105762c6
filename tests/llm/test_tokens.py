"""Encoding, decoding and counting against the tokenizers library."""

from __future__ import annotations

import hashlib
import random

import pytest
from llm_samples import ODD_TEXTS, TOKENIZER
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from motorpool.llm import bpe, token_counts
from motorpool.llm.bpe import encoder
from motorpool.llm.common import scratch
from motorpool.llm.pretokens import _pattern, pretokens

LIBRARY = Tokenizer.from_file(TOKENIZER)


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [t or "" for t in ODD_TEXTS])
def test_odd_texts_encode_as_the_library_does(text):
    ids = encoder(TOKENIZER).encode(text)
    assert ids == ids_of(text)
    assert encoder(TOKENIZER).decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False) == text


@pytest.mark.parametrize("text", [t or "" for t in ODD_TEXTS])
def test_packed_ids_are_the_ids(text, monkeypatch):
    monkeypatch.setattr(bpe, "PACKED", 3)
    of = encoder(TOKENIZER)
    of.packed.clear()
    assert of.numbers(text).tolist() == ids_of(text) and of.numbers(text).itemsize == 4
    assert len(of.packed) <= 3


def test_ids_alone_come_without_the_decoded_text(spark, odd):
    found = bpe.encode_ids(odd, TOKENIZER)
    both = bpe.encode_documents(odd, TOKENIZER).select("doc_id", "ids")
    assert found.columns == ["doc_id", "ids"] and found.dtypes == both.dtypes
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, both.collect()), key=str)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t'sdtlvermab.!?0129éüñA漢　 ​<|>endoftxt", max_size=60))
def test_random_texts_encode_as_the_library_does(text):
    assert encoder(TOKENIZER).encode(text) == ids_of(text)
    assert "".join(pretokens(text)) == text


def test_words_are_cut_as_the_pattern_says():
    draw = random.Random(5)
    for _ in range(500):
        text = "".join(draw.choice(" \n\t\r.!a9é ") for _ in range(draw.randint(1, 30)))
        assert pretokens(text) == _pattern().findall(text)


def test_two_tokens_fit_exactly_if_their_bytes_encode_to_them():
    of, draw = encoder(TOKENIZER), random.Random(1)
    made = list(of.made)
    for _ in range(3000):
        a, b = draw.choice(made), draw.choice(made)
        word = (of.bytes_of[a] + of.bytes_of[b]).decode("utf-8", "ignore")
        if word.encode() == of.bytes_of[a] + of.bytes_of[b] and word.isalpha():
            assert of.compatible(a, b) == (ids_of(word) == [a, b])


def test_ids_outside_the_vocabulary_and_broken_bytes():
    of = encoder(TOKENIZER)
    half = of.ids["é".encode()[:1]]
    assert of.decode([10**9, half]) == "�" == LIBRARY.decode([half], skip_special_tokens=False)


def test_digests_of_odd_rows(spark, odd):
    got = bpe.encoding_digests(odd, TOKENIZER)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = []
    for key, text in odd.select("doc_id", "text").collect():
        ids = ids_of(text or "")
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), text or "")]
        want.append((key, len(ids), *digest))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert bpe.encoding_digests(odd.limit(0), TOKENIZER).count() == 0


def test_real_outputs(odd):
    rows = bpe.encode_documents(odd, TOKENIZER).collect()
    assert len(rows) == odd.count()
    assert all(list(r.ids) == ids_of(r.decoded) for r in rows)


def test_counts_and_what_the_cache_learns(spark, odd):
    path = scratch(spark, "cache")
    version = token_counts.tokenizer_digest(TOKENIZER)
    got = token_counts.token_counts(odd, TOKENIZER, path)
    want = [
        (k, len((t or "").encode()), len(ids_of(t or "")), len(ids_of(t or "")) > 512)
        for k, t in odd.select("doc_id", "text").collect()
    ]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    distinct = odd.selectExpr("coalesce(text, '') t").distinct().count()
    cache = token_counts.read_cache(spark, path)
    assert cache.count() == distinct == cache.select("content").distinct().count()
    # Nothing new: nothing is encoded. One new text: one row more.
    fill = dict(key="doc_id", text="text", version=version)
    assert token_counts.fill_cache(odd, TOKENIZER, path, **fill) == 0
    more = odd.unionByName(odd.limit(1).selectExpr("99L doc_id", "'new words' text", *[c for c in odd.columns[2:]]))
    assert token_counts.fill_cache(more, TOKENIZER, path, **fill) == 1
    assert token_counts.read_cache(spark, path).count() == distinct + 1


def test_words_forgotten_and_met_again(monkeypatch):
    monkeypatch.setattr(token_counts, "WORDS", 3)
    of = token_counts.WordCounter(TOKENIZER)
    for texts in (["one two three four five"], ["one two six"], ["six seven one", "eight nine", ""], ["five one"]):
        assert of.count_all(texts) == [len(ids_of(t)) for t in texts]
        assert set(of.counts) >= {w for t in texts for w in pretokens(t)}


def test_counts_come_from_the_cache_and_only_of_the_same_tokenizer(spark):
    path, version = scratch(spark, "cache"), token_counts.tokenizer_digest(TOKENIZER)
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    digest = hashlib.sha256(b"some text").digest()
    rows = [(bytearray(digest), version, 77), (bytearray(digest), "another", 5)]
    spark.createDataFrame(rows, token_counts.CACHE_SCHEMA).write.parquet(path)
    assert token_counts.token_counts(docs, TOKENIZER, path).first().n_tokens == 77


def test_empty_table_leaves_the_cache(spark, odd):
    path = scratch(spark, "cache")
    assert token_counts.token_counts(odd.limit(0), TOKENIZER, path).count() == 0
    assert token_counts.read_cache(spark, path).count() == 0


def test_other_kinds_of_tokenizers(spark):
    import public_tokenizers
    import sentencepiece

    docs = spark.createDataFrame([(1, "Hello there, world"), (2, None)], "doc_id long, text string")
    model = public_tokenizers.path("piece_bpe_32k.model")
    want = len(sentencepiece.SentencePieceProcessor(model_file=model).encode("Hello there, world"))
    got = token_counts.token_counts(docs, model, scratch(spark, "cache")).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [want, 0]
    words = public_tokenizers.path("word_bpe_49k.json")
    want = len(Tokenizer.from_file(words).encode("Hello there, world", add_special_tokens=False).ids)
    got = token_counts.token_counts(docs, words, scratch(spark, "cache")).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [want, 0]
