"""Patterns, the random field and its decoding."""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pytest

from motorpool.llm import secret_scan as S
from motorpool.llm.queries import op1_secret_scans
from llm_samples import DATA

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def plain_base(text):
    """Every match of the patterns as they are written down, the failing ones dropped."""
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


@pytest.mark.parametrize(
    "text",
    [
        "", "token=abc", "token=abcdef", "TOKEN = 'a.b=c/d+e_f-g'", "secret:token:abcdef", "token=token=abcdef", "api_key\": \"123456",
        "ApiKey : x12345é", "AKIA" + "A" * 15, "AKIA" + "B" * 16, "xAKIAAKIA" + "9" * 16, "0" * 23, "0" * 24, "f" * 60 + "g" + "1" * 24,
        "toKen=abcdef", "ſecret=abcdef", "é😀 password=hunter22 漢字 " + "ab12" * 7, "token\n=abcdef", "token =\t abcdef",
    ],
)
def test_base_patterns(text):
    got = [f"{k}:{a}:{b}" for a, b, k in S.spans([text], S.Field.blank())[0]]
    assert got == plain_base(text)


def some_field():
    draw = np.random.default_rng(4)
    words = "the quick brown fox jumps over lazy dogs while rain falls".split()
    texts = []
    for i in range(120):
        prose = " ".join(draw.choice(words, 60))
        secret = "".join(draw.choice(list("0123456789abcdef"), 40))
        texts.append(f'{prose} token = "{secret}" {prose}' if i % 2 else prose)
    return S.fit(*S.windows(texts))


def test_field_finds_what_the_patterns_miss_and_leaves_prose_alone():
    field = some_field()
    text = 'the fox jumps credential = "Xk29fLq8ZtW03mNvB7yRaa" over lazy dogs'
    assert S.base_spans(text) == []
    ((a, b, kind),) = S.spans([text], field)[0]
    assert (text[a:b], kind) == ("Xk29fLq8ZtW03mNvB7yRaa", "tagged")
    assert S.spans(["the quick brown fox, 12 dogs and rain. " * 50, "", "x"], field) == [[], [], []]


def test_likelihood_has_been_climbed():
    table, tags = S.windows(['a b c token = "0123456789abcdef01234567" d e f'] * 4 + ["a b c d e f g"] * 4)
    field = S.fit(table, tags)
    scores = field.scores(table.reshape(-1, table.shape[2])).reshape(*tags.shape, 3)
    begin = tags == S.BEGIN
    assert (scores[begin].argmax(axis=1) == S.BEGIN).all()


def test_stretches_between_sure_tokens_give_the_best_path():
    draw = np.random.default_rng(0)
    for _ in range(200):
        field = S.Field(draw.normal(size=(S.N_FEATURES, 3)) * draw.choice([0.3, 1, 3]), draw.normal(size=(3, 3)))
        field.step[S.OUTSIDE, S.INSIDE] = -20
        tokens = S.features(["ab 12x = 'QQ12' foo", "zz", "", "a1b2c3d4 e5f6 g"])
        got, scores = field.tags(tokens), field.scores(tokens.features)
        for text in set(tokens.text.tolist()):
            at = np.flatnonzero(tokens.text == text)

            def value(path, at=at, scores=scores, field=field):
                steps = sum(field.step[x, y] for x, y in zip(path, path[1:]))
                return sum(scores[i, t] for i, t in zip(at, path)) + steps + (field.step[0, 2] if path[0] == 2 else 0)

            best = max(itertools.product(range(3), repeat=len(at)), key=value)
            assert np.isclose(value(best), value(got[at]))


def test_a_very_long_token_counts_right():
    short, long = (S.features(["9" * n, "a1"]).features for n in (5000, (1 << 21) + 3))
    assert (short[:, :7] == long[:, :7]).all()


def test_time_of_spans_grows_with_the_text():
    import time

    field = some_field()
    line = 'token = "0123456789abcdef01234567" credential = "Xk29fLq8ZtW03mNvB7yRaa" over lazy dogs\n'

    def spent(n):
        started = time.process_time()
        assert len(S.spans([line * n], field)[0]) >= 2 * n
        return time.process_time() - started

    spent(100)
    assert min(spent(8000) for _ in range(2)) < 3.5 * min(spent(4000) for _ in range(2))


SHAPES = {
    "bearer": lambda d: "Authorization: Bearer " + "".join(d.choice(list("ABCDEFGHJKabcdefghjk0123456789-_"), 40)),
    "credential": lambda d: 'credential = "' + "".join(d.choice(list("ABCDEFGHJKLMNPQRSTabcdefghkmnpqrst23456789"), 24)) + '"',
    "prefixed": lambda d: "key: sk_live_" + "".join(d.choice(list("abcdefghijkABCDEFGHIJK0123456789"), 28)),
    "upper hex": lambda d: "signature=" + "".join(d.choice(list("0123456789ABCDEF"), 40)),
}


def test_tagged_spans_of_planted_secrets(spark):
    """Secrets of shapes the patterns do not know, planted into documents of the table: how many are tagged, and what else."""
    # A table in which the patterns find something to learn from: some hundred documents of 10,000.
    docs = spark.read.parquet(f"{DATA}/../sf0.1/documents.parquet")
    field = S.train(docs)
    draw, texts = np.random.default_rng(12), sorted(r.text or "" for r in docs.where("doc_id % 20 = 0").collect())
    hit = dict.fromkeys(SHAPES, 0)
    wrong = planted = 0
    for turn in range(40):
        for name, make in SHAPES.items():
            text = texts[int(draw.integers(len(texts)))]
            cut = text.find(" ", int(draw.integers(max(1, len(text)))))
            at = cut if cut >= 0 else len(text)
            secret = make(draw)
            value = re.split(r'[ ="]+', secret.rstrip('"'))[-1]
            new = f"{text[:at]} {secret} {text[at:]}"
            low = new.index(value, at)
            found = S.spans([new], field)[0]
            touching = [s for s in found if s[0] < low + len(value) and s[1] > low]
            hit[name] += bool(touching)
            wrong += sum(k == "tagged" and s not in touching for s in found for k in s[2:])
            planted += 1
    print(f"tagged {hit} of 40 each, {wrong} others in {planted} documents")
    assert sum(hit.values()) >= 0.4 * planted and wrong <= 0.05 * planted


def digest(parts):
    return hashlib.sha256(",".join(parts).encode()).hexdigest()


def test_odd_rows(odd):
    got = S.scan(odd)
    want = []
    for key, text in odd.select("doc_id", "text").collect():
        base = plain_base(text)
        counts = [sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex")]
        want.append((key, *counts, digest(base)))
    assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert S.scan(odd.limit(0)).count() == 0


def test_query_is_whole(spark):
    rows = op1_secret_scans(spark, DATA).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        base = plain_base(docs[r.doc_id])
        assert r.base_sha256 == digest(base)
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("tagged")] == base


def test_redaction():
    text = "a token=abcdef b " + "0" * 24
    found = S.spans([text], S.Field.blank())[0]
    assert S.redact(text, found) == "a [secret] b [secret]"
    assert S.redact("token=" + "0" * 24, [(0, 30, "assign"), (6, 30, "hex")]) == "[secret]"


def test_rows_without_secrets_stay_as_they_are(odd):
    kept = S.without_secrets(odd, field=S.Field.blank())
    assert kept.columns == odd.columns and kept.count() == odd.count()
    secret = "text like 'token =%' or text like 'aaaaaa%'"
    before = {repr(tuple(r)) for r in odd.where(f"not ({secret}) or text is null").collect()}
    after = {repr(tuple(r)) for r in kept.where("text not like '%[secret]%' or text is null").collect()}
    assert before == after
    changed = kept.where("text like '%[secret]%'").collect()
    assert sorted((r.text, r.n_chars) for r in changed) == [("[secret]", 8), ('[secret]"', 9)]
