"""Label model, classifier and held-out accuracy."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from motorpool.llm import toxicity as X
from motorpool.llm.queries import op9_toxicity

SF = "/root/testdata/sf0.01"


def test_label_model_learns_accuracies_and_finds_repetition():
    draw = np.random.default_rng(1)
    truth = draw.random(4000) < 0.5
    good = np.where(truth, draw.random(4000) < 0.7, draw.random(4000) < 0.02)
    poor = np.where(truth, draw.random(4000) < 0.4, draw.random(4000) < 0.3)
    votes = np.column_stack([good, good, poor]).astype(float)
    gold = np.where(draw.random(4000) < 0.1, ~truth, truth).astype(int)  # a tenth of the labels is wrong
    voters, belief = X.label_model(votes, gold, entries=2)
    assert voters.accuracy[0] > 0.9 > voters.accuracy[2] + 0.2
    assert voters.repeats[0] > 1.8 and voters.repeats[2] < 1.4
    assert ((belief > 0.5) == truth).mean() > (gold == truth).mean()


def test_linear_and_calibration():
    draw = np.random.default_rng(2)
    x = (draw.random((600, 5)) < 0.3).astype(np.float32)
    gold = (x[:, 0] > 0).astype(int)
    weights, bias = X.linear(x, np.where(gold == 1, 0.95, 0.05))
    assert weights.argmax() == 0
    slope, shift = X.calibration(x @ weights + bias, gold, 0.1)
    odds = slope * (x @ weights + bias) + shift
    assert (odds[gold == 1] > 0).all() and (odds[gold == 0] < 0).all()


def test_levels_need_number_and_density():
    assert [X.levels(n, 100) for n in (0, 1, 2, 4)] == [0, 1, 2, 3]
    assert X.levels(4, 100_000) == 1
    assert set(X.leveled(["loser", "loser"], {"=loser": 1})) == {"=loser", "=loser 2"}


def test_shouting_is_of_the_whole_text():
    shouting = X.PATTERNS.index("shouting")
    shows = lambda t: shouting in X.patterns(t, X.words_of(t))
    assert shows("LOUD WORDS, 1 AFTER ANOTHER! " * 100) and not shows("LOUD " * 500 + "and then quietly on " * 500)
    assert not shows("LOUD") and not shows("1234567890 " * 10)


@pytest.fixture(scope="module")
def scored(spark):
    return op9_toxicity(spark, SF).toPandas().set_index("doc_id")


def test_query_is_whole_and_in_shape(spark, scored):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(scored) == docs.count()
    assert scored.score.between(0, 1).all()
    assert (scored.predicted == (scored.score >= 0.7)).all()
    assert all(scored.held_out[i] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in scored.index)


def test_held_out_accuracy(spark, scored):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")
    held = scored.join(labels, how="inner").query("held_out")
    ranks = held.score.rank()
    n, m = (held.toxic == 1).sum(), (held.toxic == 0).sum()
    assert (ranks[held.toxic == 1].sum() - n * (n + 1) / 2) / (n * m) > 0.85
    assert held[held.toxic == 0].predicted.mean() < 0.02
    assert held[held.toxic == 1].predicted.mean() > 0.5


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - toxic, toxic) as toxic")
    one, two = X.train(docs, labels), X.train(docs, turned)
    assert one.bias == two.bias and one.weights == two.weights


def test_odd_rows(spark, odd):
    rows = [(0, 1), (1, 0), (2, 1), (4, 0), (5, 1), (5, 0), (6, None), (None, 1), (8, 0), (9, 1), (10, 0), (77, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, toxic int").selectExpr("*", "1 as text", "2 as name")
    model = X.train(odd, labels)
    got = X.score(odd, model)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == odd.count()
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert X.without_toxic(odd, model).columns == odd.columns
    assert X.score(odd.limit(0), model).count() == 0


def test_without_labels_nothing_is_toxic(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in X.score(odd, X.train(odd, labels)).collect()} == {0}
    assert X.without_toxic(odd, X.Classifier()).count() == odd.count()
