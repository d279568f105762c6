"""Toxicity by weak supervision.

Many voters look at a document: entries of lexicons (words and beginnings of words that training rows mark as toxic,
and a short fixed list), patterns of writing, and the label itself. A generative model of the votes estimates how often
each voter fires on toxic and on other documents and which voters repeat one another; it turns the votes of a document
into a posterior label. A linear classifier over words, word beginnings and patterns learns these posterior labels and
scores every document.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorpool.llm.common import claim, per_row, stretches, text_or_empty

# Labelled training rows used, of each class at most.
ROWS_PER_CLASS = 4000
# Words and word beginnings that can be features, and lexicon entries that vote.
FEATURES, ENTRIES = 1024, 256
BEGINNINGS = (3, 4, 5, 6, 7)
# A word or beginning counts at these levels: so many times at least, and in so many of a thousand words.
LEVELS = ((1, 0.0), (2, 2.0), (4, 4.0))
WORD = re.compile(r"[^\W\d_]+")
# A start for the lexicon voters, whatever the training rows hold.
INSULTS = frozenset("idiot stupid moron loser scum trash worthless pathetic disgusting clown imbecile vermin dumb ugly".split())
PATTERNS = ("insult", "two insults", "shouting", "exclaiming", "you are", "masked", "no letters", "short")
# Words a worker remembers the features of.
WORDS = 250_000


def training_fold(key: Column) -> Column:
    """Rows whose labels may be used."""
    return F.crc32(key.cast("string").cast("binary")) % 3 != 1


def patterns(text: str, words: list[str]) -> list[int]:
    """Which patterns of writing a text shows, by position in PATTERNS."""
    insults = len(INSULTS.intersection(words))
    letters = sum(map(len, words))
    found = [insults > 0, insults > 1]
    found.append(len(text) > 20 and text.isupper())
    found += ["!!" in text, "you are" in text or "You are" in text, "**" in text or "@#" in text, letters == 0, len(text) < 100]
    return [i for i, x in enumerate(found) if x]


def forms(word: str) -> list[str]:
    """Feature names of a word: the word and its beginnings."""
    return ["=" + word, *(word[:n] + "-" for n in BEGINNINGS if len(word) > n)]


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def levels(count: int, words: int) -> int:
    """How many of LEVELS a count reaches; they are reached in turn."""
    reached = 0
    for least, per_thousand in LEVELS:
        if count < least or count * 1000 < per_thousand * words:
            break
        reached += 1
    return reached


def leveled(words: list[str], wanted: Mapping[str, object] | None = None) -> list[str]:
    """Names of all (wanted) features of a text: "name" at the first level, "name 2" at the second ..."""
    total: Counter[str] = Counter()
    for w, n in Counter(words).items():
        for f in forms(w):
            if wanted is None or f in wanted:
                total[f] += n
    return [f if i == 0 else f"{f} {i + 1}" for f, n in total.items() for i in range(levels(n, len(words)))]


@dataclass
class Voters:
    """What the generative model says of each voter: how often it is right to mean toxic, and what it repeats."""

    accuracy: np.ndarray
    repeats: np.ndarray
    share: float

    def beliefs(self, fires: np.ndarray) -> np.ndarray:
        """Posterior label of each row. A voter that does not fire abstains."""
        prior = np.log(self.share / (1 - self.share))
        evidence = (np.log(self.accuracy / (1 - self.accuracy)) - prior) / self.repeats
        return 1 / (1 + np.exp(-np.clip(prior + fires @ evidence, -30, 30)))


def label_model(votes: np.ndarray, gold: np.ndarray, entries: int, rounds: int = 12) -> tuple[Voters, np.ndarray]:
    """Fit the voters by expectation maximisation; returns them and the posterior label of each row.

    ``votes`` is rows x voters (1 where one fires), the first ``entries`` of them lexicon entries. Three more voters are
    added: "no entry fires", and the label, which votes like the others, once for each of its values. The labels start
    the posterior; from then on every voter's accuracy is estimated against it. Correlated voters are found from what
    is left of their votes once the posterior is accounted for; the evidence of a voter is divided by how many voters
    it repeats, itself included.
    """
    silent = votes[:, :entries].max(axis=1, initial=0) == 0
    fires = np.column_stack([votes, silent, gold == 1, gold == 0]).astype(np.float32)
    belief = np.where(gold == 1, 0.95, 0.05)
    voters = Voters(np.full(fires.shape[1], 0.5), np.ones(fires.shape[1]), 0.5)
    for _ in range(rounds):
        share = float(np.clip(belief.mean(), 0.02, 0.98))
        accuracy = (belief @ fires + share) / (fires.sum(axis=0) + 1)
        high = (belief @ fires + 0.1) / (belief.sum() + 1)
        low = ((1 - belief) @ fires + 0.1) / ((1 - belief).sum() + 1)
        rest = (fires - np.outer(belief, high) - np.outer(1 - belief, low)).astype(np.float32)
        spread = rest.std(axis=0) + 1e-9
        alike = (rest.T @ rest) / len(rest) / np.outer(spread, spread)
        np.fill_diagonal(alike, 1)
        repeats = np.where(alike > 0.1, np.minimum(alike, 1), 0).sum(axis=1)
        voters = Voters(np.clip(accuracy, 0.01, 0.99), repeats, share)
        belief = voters.beliefs(fires)
    return voters, belief


@dataclass
class Classifier:
    """Linear scores over feature names; ``bias`` alone for a text with none of them."""

    weights: dict[str, list[float]] = field(default_factory=dict)  # by name: at each level, added up
    pattern_weights: np.ndarray = field(default_factory=lambda: np.zeros(len(PATTERNS)))
    bias: float = -2.0
    _words: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)

    def score(self, text: str) -> float:
        words = words_of(text)
        if len(self._words) > WORDS:
            self._words.clear()
        known, weights = self._words, self.weights
        counts: dict[str, int] = {}
        for w in words:
            names = known.get(w)
            if names is None:
                names = known[w] = tuple(n for n in forms(w) if n in weights)
            for n in names:
                counts[n] = counts.get(n, 0) + 1
        total = self.bias
        for n in sorted(counts):
            if reached := levels(counts[n], len(words)):
                total += weights[n][reached - 1]
        total += sum(float(self.pattern_weights[i]) for i in patterns(text, words))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_words": {}}


def linear(x: np.ndarray, belief: np.ndarray, rounds: int = 250, rate: float = 0.05, shrink: float = 2e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, both classes weighing alike; by Adam."""
    weights, bias = np.zeros(x.shape[1], np.float32), 0.0
    share = float(np.clip(belief.mean(), 1e-3, 1 - 1e-3))
    # A row counts by how much its likely class needs to be lifted.
    lift = (belief * 0.5 / share + (1 - belief) * 0.5 / (1 - share)).astype(np.float32)
    goal = belief.astype(np.float32)
    mean, power = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for turn in range(1, rounds + 1):
        guess = 1 / (1 + np.exp(-np.clip(x @ weights + bias, -30, 30)))
        error = (goal - guess) * lift / len(x)
        up = np.append(x.T @ error - shrink * weights, error.sum())
        mean, power = 0.9 * mean + 0.1 * up, 0.99 * power + 0.01 * up * up
        move = rate * (mean / (1 - 0.9**turn)) / (np.sqrt(power / (1 - 0.99**turn)) + 1e-8)
        weights += move[:-1].astype(np.float32)
        bias += float(move[-1])
    return weights, bias


def calibration(raw: np.ndarray, gold: np.ndarray, rate: float, rounds: int = 40) -> tuple[float, float]:
    """Slope and shift that turn raw scores of rows not trained on into the log odds of the label.

    Rows weigh so that the share ``rate`` of them is toxic. The slope is held at zero or more.
    """
    share = float(np.clip(gold.mean(), 1e-3, 1 - 1e-3))
    weigh = np.where(gold == 1, rate / share, (1 - rate) / (1 - share)) / len(gold)
    n_toxic, n_clean = (gold == 1).sum(), (gold == 0).sum()
    goal = np.where(gold == 1, (n_toxic + 1) / (n_toxic + 2), 1 / (n_clean + 2))
    at = np.array([1.0, np.log(rate / (1 - rate))])
    columns = np.column_stack([raw, np.ones_like(raw)])
    for _ in range(rounds):
        guess = 1 / (1 + np.exp(-np.clip(columns @ at, -30, 30)))
        up = columns.T @ (weigh * (goal - guess)) - 1e-4 * at
        bend = (columns * (weigh * guess * (1 - guess))[:, None]).T @ columns + np.eye(2) * 1e-4
        at = at + np.clip(np.linalg.solve(bend, up), -1.0, 1.0)
    return max(float(at[0]), 0.0), float(at[1])


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Classifier:
    """Fit lexicons, voters and classifier on at most ROWS_PER_CLASS labelled rows of each class.

    Only rows of the training fold are used, chosen by a hash of the key. A key with several labels is toxic if one of
    them says so; rows without text or label are left out. Without rows of both classes the classifier calls nothing
    toxic.
    """
    known = labels.where(training_fold(F.col(key)) & F.col(label).isNotNull()).groupBy(F.col(key).alias("__id"))
    known = known.agg(F.max(label).cast("int").alias("toxic")).withColumn("order", F.xxhash64("__id"))
    rate = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    per_class = [known.where(F.col("toxic") == c).orderBy("order").limit(ROWS_PER_CLASS) for c in (1, 0)]
    chosen = F.broadcast(per_class[0].unionAll(per_class[1]).select("__id", "toxic"))  # 2 * ROWS_PER_CLASS rows at most
    sample = docs.select(F.col(key).alias("__id"), text_or_empty(text).alias("text")).join(chosen, "__id").select("toxic", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in stretches(batches):
            for is_toxic, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (toxic if is_toxic else clean).update(leveled(words_of(t)))
        names = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_pydict(
            {"name": names, "toxic": [toxic[n] for n in names], "clean": [clean[n] for n in names]}, _COUNTS
        )

    totals = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic or not n_clean:
        return Classifier()
    # How far the two shares lie apart, in standard deviations of their difference.
    of_toxic, of_clean = F.col("toxic") / n_toxic, F.col("clean") / n_clean
    overall = (F.col("toxic") + F.col("clean")) / (n_toxic + n_clean)
    apart = (of_toxic - of_clean) / F.sqrt(F.greatest(overall * (1 - overall), F.lit(1e-9)) * (1 / n_toxic + 1 / n_clean))
    counts = sample.mapInArrow(count, "name string, toxic long, clean long").groupBy("name")
    counts = counts.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).withColumn("z", apart)
    best = counts.where((F.col("toxic") + F.col("clean") >= 2) & (F.abs("z") > 1.5)).orderBy(F.abs("z").desc(), "name").limit(FEATURES).collect()
    names = [r["name"] for r in best]
    place = {n: i for i, n in enumerate(names)}
    wanted = dict.fromkeys(n.split(" ")[0] for n in names)
    entries = [i for i, r in enumerate(best) if r["z"] > 2 and r["toxic"] * (n_clean + 1) >= 4 * r["clean"] * (n_toxic + 1)][:ENTRIES]

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stretches(batches):
            found = []
            for t in batch.column(1).to_pylist():
                words = words_of(t)
                have = sorted(place[f] for f in leveled(words, wanted) if f in place)
                found.append(have + [len(names) + i for i in patterns(t, words)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["toxic", "shown"])

    rows = sorted((r[0], list(r[1])) for r in sample.mapInArrow(show, "toxic int, shown array<int>").collect())
    x = np.zeros((len(rows), len(names) + len(PATTERNS)), np.float32)
    for i, (_, shown) in enumerate(rows):
        x[i, shown] = 1
    gold = np.array([r[0] for r in rows])
    voters = [*entries, *range(len(names), x.shape[1])]
    _, belief = label_model(x[:, voters], gold, len(entries))
    raw = np.zeros(len(rows))
    for half in (0, 1):
        other = np.arange(len(rows)) % 2 != half
        if len(set(gold[other])) == 2:
            weights, bias = linear(x[other], belief[other])
            raw[~other] = x[~other] @ weights + bias
    slope, shift = calibration(raw, gold, float(np.clip(rate, 1e-3, 1 - 1e-3)))
    weights, bias = linear(x, belief)
    weights, bias = weights * slope, bias * slope + shift
    added: dict[str, list[float]] = {}
    for name in wanted:
        steps = [name if i == 0 else f"{name} {i + 1}" for i in range(len(LEVELS))]
        added[name] = np.cumsum([float(weights[place[n]]) if n in place else 0.0 for n in steps]).tolist()
    return Classifier(added, weights[len(names) :].astype(float), float(bias))


_COUNTS = pa.schema([("name", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])


def score(
    docs: DataFrame, model: Classifier, *, key: str = "doc_id", text: str = "text", threshold: float = 0.7
) -> DataFrame:
    """``key``, ``held_out``, ``score`` and ``predicted`` of every whole text.

    Null and empty texts have the score of a text that shows nothing. Repeated rows and null keys are kept (a null key
    counts as training fold); extra columns are not read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        of = shared.value
        for batch in stretches(batches):
            scores = [of.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], [key, "score"])

    scored = docs.select(F.col(key), text_or_empty(text).alias("__text")).mapInArrow(run, f"`{key}` {kind}, score double")
    held_out = F.coalesce(~training_fold(F.col(key)), F.lit(False)).alias("held_out")
    return scored.select(key, held_out, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Classifier, *, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, as they are, whose text scores below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def build():
        of = shared.value
        return lambda texts, batch: batch.filter(pa.array([of.score(t) < threshold for t in texts], pa.bool_()))

    return per_row(docs, text, build)
