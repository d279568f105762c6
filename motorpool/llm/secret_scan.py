"""Secrets in text: fixed patterns, and a linear-chain conditional random field that adds what they miss.

The field tags every token as the begin of a secret, inside one, or outside. Its features are the shape of the token,
its neighbours and the signs between them, and features of the whole file. It is trained on windows of tokens around
pattern matches and elsewhere, from a bounded sample of documents, and decoded by Viterbi.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorpool.llm.common import claim, hex_sha256, per_row, stretches, text_or_empty

# Fixed patterns of the base kinds.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
KINDS = ("assign", "access", "hex", "tagged")
# The same in Java's dialect: which documents are worth learning from.
HINT = "(?i:(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=])|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"

OUTSIDE, BEGIN, INSIDE = 0, 1, 2
# Documents to learn from: so many with a pattern, so many of all; windows taken from one; tokens in a window.
SAMPLE, WINDOWS, WIDTH = 400, 6, 33
HASHES = 2048

Span = tuple[int, str, int]


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """Pattern matches as (start, end, kind, start of the secret itself), leftmost first and apart within a kind."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), m.end(), "assign", m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(m.start(), m.end(), "hex", m.start()) for m in HEX.finditer(text)]


# --- features ----------------------------------------------------------------------------------

SEPARATOR, HEXLETTER, LOWER, UPPER, DIGIT, SIGN, WIDE = range(7)
_CLASS = np.full(129, SIGN, dtype=np.uint8)
_CLASS[[*range(33), 127, *map(ord, "\"'`()[]{}<>,;|:=")]] = SEPARATOR
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[97:103], _CLASS[128] = DIGIT, UPPER, LOWER, HEXLETTER, WIDE
# What a sign adds to three counters of 21 bits each: classes first, then signs and what stands between tokens.
_MASK = np.uint64((1 << 21) - 1)


def _counters(*sets: np.ndarray) -> np.ndarray:
    return sum((held.astype(np.uint64) << np.uint64(21 * i) for i, held in enumerate(sets)), np.zeros(129, np.uint64))


_SIGNS = np.arange(129)
_COUNT_A = _counters(_CLASS == DIGIT, _CLASS == UPPER, _CLASS == HEXLETTER)
_COUNT_B = _counters(_CLASS == LOWER, (_CLASS == SIGN) | np.isin(_SIGNS, (61, 58)), (_CLASS == WIDE) | np.isin(_SIGNS, (34, 39, 96)))
_LENGTHS = np.array([4, 8, 12, 16, 20, 24, 32, 40])
_CHANGES = np.array([1, 2, 4, 8])
# Sizes of the feature groups, in the order in which ``features`` lists them.
GROUPS = (45, 5, 6, 2, 2, 2, 4, HASHES, HASHES, HASHES, 3, 3, 3)
STARTS = np.cumsum([0, *GROUPS[:-1]])
N_FEATURES = sum(GROUPS)


@dataclass
class Tokens:
    """Tokens of several texts laid end to end."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    features: np.ndarray


def _shifted(values: np.ndarray, by: int, same: np.ndarray, nothing: int) -> np.ndarray:
    """The value ``by`` tokens away, or ``nothing`` outside the text."""
    found = np.roll(values, -by)
    other = np.roll(same, -by)
    if by > 0:
        other[-by:] = -1
    else:
        other[:-by] = -1
    return np.where(other == same, found, nothing)


def features(texts: list[str]) -> Tokens:
    """Cut the texts into tokens and list the features of each, all at once."""
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sign = np.minimum(codes, 128).astype(np.uint8)
    kind = _CLASS[sign]
    inside = np.concatenate(([False], kind != SEPARATOR, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    offsets = np.cumsum(sizes) - sizes
    if not len(start):
        return Tokens(start, end, start, np.zeros((0, len(GROUPS)), dtype=np.int32))
    text = np.searchsorted(offsets, start, side="right") - 1
    length = end - start
    # Counts within tokens and, of the same signs, between them (what follows a token stands before the next one).
    # Three counters go together, unless a token is so long that one would run into the next.
    apart = np.diff(edges, append=len(sign)).max() > int(_MASK)
    counted = [np.add.reduceat(table[sign], edges) for table in (() if apart else (_COUNT_A, _COUNT_B))]

    def part(which: int, field: int, gaps: bool = False) -> np.ndarray:
        shift = np.uint64(21 * field)
        if apart:
            of_signs = ((_COUNT_A, _COUNT_B)[which] >> shift & _MASK).astype(np.int64)
            return np.add.reduceat(of_signs[sign], edges)[1 if gaps else 0 :: 2]
        return ((counted[which][1 if gaps else 0 :: 2] >> shift) & _MASK).astype(np.int64)

    digits, uppers, hexes, lowers, signs, wide = (part(w, f) for w in (0, 1) for f in range(3))
    assigned, quoted = (np.concatenate(([0], part(1, f, gaps=True)[:-1] > 0)).astype(np.int64) for f in (1, 2))
    coarse = np.where(kind == HEXLETTER, LOWER, kind)
    changed = np.concatenate(([False], (coarse[1:] != coarse[:-1]) & (kind[:-1] != SEPARATOR)))
    changes = np.add.reduceat(changed, edges, dtype=np.int32)[::2]
    letters = lowers + hexes + uppers
    long = np.searchsorted(_LENGTHS, length, side="right")
    varied_ = np.searchsorted(_CHANGES, changes, side="right")
    share = (digits > 0) + (digits * 4 >= length) * 1 + (digits * 2 >= length) + (digits >= length)
    first_upper = kind[start] == UPPER
    case = np.where(
        letters == 0, 0, np.where(uppers == 0, 1, np.where(uppers == letters, 2, np.where((uppers == 1) & first_upper, 3, np.where(wide > 0, 4, 5))))
    )
    pure_hex = (hexes + digits == length) & (digits > 0) & (hexes > 0)
    # A word is known by its first six and last two signs and its length.
    low = codes | ((kind == UPPER).astype(np.uint32) << np.uint32(5))
    word = length.astype(np.uint64)
    for j in range(8):
        here = np.minimum(start + j, end - 1) if j < 6 else np.maximum(end - (j - 5), start)
        word = word * np.uint64(1099511628211) ^ low[here]
    word = ((word ^ (word >> np.uint64(29))) % np.uint64(HASHES - 1)).astype(np.int64) + 1
    # Of the whole file.
    n_text = len(texts)
    count = np.maximum(np.bincount(text, minlength=n_text), 1)
    of_file = [
        np.select([x == 0, x < 0.02], [0, 1], 2)[text]
        for x in (np.bincount(text, assigned, n_text) / count, np.bincount(text, (digits > 0).astype(float), n_text) / count)
    ]
    size = np.searchsorted([50, 1000], count, side="right")[text]
    columns = (
        long * 5 + varied_, share, case, pure_hex, signs > 0, quoted, assigned * 2 + (length >= 6),
        _shifted(word, -1, text, 0), _shifted(word, -2, text, 0), _shifted(word, 1, text, 0), *of_file, size,
    )
    table = np.stack([c.astype(np.int32) for c in columns], axis=1) + STARTS.astype(np.int32)
    return Tokens(start - offsets[text], end - offsets[text], text, table)


# --- the field -----------------------------------------------------------------------------------


@dataclass
class Field:
    """Weights of a linear chain over the three tags."""

    emit: np.ndarray  # features x tags
    step: np.ndarray  # tag before x tag

    @classmethod
    def blank(cls) -> Field:
        step = np.zeros((3, 3))
        step[OUTSIDE, INSIDE] = -20.0  # nothing goes on that has not begun
        return cls(np.zeros((N_FEATURES, 3)), step)

    def scores(self, table: np.ndarray) -> np.ndarray:
        total = np.zeros((len(table), 3))
        for column in table.T:
            total += self.emit[column]
        return total

    def tags(self, tokens: Tokens) -> np.ndarray:
        """The best tag sequence of each text.

        Where a token scores so much better outside that no step to its neighbours could make up for it, the best
        path is outside there; only the stretches between such tokens are searched, which gives the same path.
        """
        best = np.zeros(len(tokens.start), dtype=np.int8)
        if not len(best):
            return best
        scores = self.scores(tokens.features)
        step = self.step
        gain = max(
            step[a, t] + step[t, b] - step[a, OUTSIDE] - step[OUTSIDE, b] for a in range(3) for b in range(3) for t in (1, 2)
        )
        gain = max(gain, *(step[a, t] - step[a, OUTSIDE] for a in range(3) for t in (1, 2)))
        gain = max(gain, *(step[t, b] - step[OUTSIDE, b] for b in range(3) for t in (1, 2)), 0.0)
        open_ = np.flatnonzero(scores[:, OUTSIDE] - np.maximum(scores[:, BEGIN], scores[:, INSIDE]) <= gain)
        if not len(open_):
            return best
        apart = np.flatnonzero((np.diff(open_) > 1) | (np.diff(tokens.text[open_]) != 0)) + 1
        for piece in np.split(open_, apart):
            # Outside just before and after, or a text border there: the first token takes no step into INSIDE.
            first, last = piece[0], piece[-1]
            follows = first > 0 and tokens.text[first - 1] == tokens.text[first]
            precedes = last + 1 < len(best) and tokens.text[last + 1] == tokens.text[last]
            best[first : last + 1] = self.viterbi(scores[first : last + 1], follows, precedes)
        return best

    def viterbi(self, scores: np.ndarray, after_outside: bool = False, before_outside: bool = False) -> np.ndarray:
        value = scores[0] + self.step[OUTSIDE] * (1.0 if after_outside else 0.0)
        if not after_outside:
            value = value + np.array([0.0, 0.0, self.step[OUTSIDE, INSIDE]])
        back = np.zeros((len(scores), 3), dtype=np.int8)
        for i in range(1, len(scores)):
            through = value[:, None] + self.step
            back[i] = through.argmax(axis=0)
            value = through.max(axis=0) + scores[i]
        if before_outside:
            value = value + self.step[:, OUTSIDE]
        path = np.zeros(len(scores), dtype=np.int8)
        path[-1] = value.argmax()
        for i in range(len(scores) - 1, 0, -1):
            path[i - 1] = back[i, path[i]]
        return path


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def fit(table: np.ndarray, tags: np.ndarray, rounds: int = 60, rate: float = 0.15, shrink: float = 1e-4) -> Field:
    """Maximum likelihood over windows (windows x tokens x features; tag -1 fills up a window), by Adam."""
    field = Field.blank()
    n, width, _ = table.shape
    held = tags >= 0
    flat, gold = table[held], np.where(held, tags, 0)
    pairs = held[:, 1:] & held[:, :-1]
    seen = np.zeros((3, 3))
    np.add.at(seen, (gold[:, :-1][pairs], gold[:, 1:][pairs]), 1.0)
    one_hot = np.eye(3)[gold]
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (field.emit, field.step)]
    for turn in range(1, rounds + 1):
        scores = np.zeros((n, width, 3))
        scores[held] = field.scores(flat)
        scores[:, 0, INSIDE] += field.step[OUTSIDE, INSIDE]
        ahead = np.empty_like(scores)
        ahead[:, 0] = scores[:, 0]
        for i in range(1, width):
            moved = _logsum(ahead[:, i - 1, :, None] + field.step, 1) + scores[:, i]
            ahead[:, i] = np.where(held[:, i, None], moved, ahead[:, i - 1])
        whole = _logsum(ahead[:, -1], 1)
        behind = np.zeros_like(scores)
        for i in range(width - 2, -1, -1):
            moved = _logsum(field.step + (scores[:, i + 1] + behind[:, i + 1])[:, None, :], 2)
            behind[:, i] = np.where(held[:, i + 1, None], moved, behind[:, i + 1])
        share = np.exp(ahead + behind - whole[:, None, None])
        error = ((one_hot - share) * held[:, :, None])[held]
        up_emit = np.zeros_like(field.emit)
        for column in flat.T:
            for t in range(3):
                up_emit[:, t] += np.bincount(column, error[:, t], N_FEATURES)
        between = ahead[:, :-1, :, None] + field.step + (scores + behind)[:, 1:, None, :] - whole[:, None, None, None]
        expected = (np.exp(between) * pairs[:, :, None, None]).sum(axis=(0, 1))
        up_step = seen - expected
        up_step[OUTSIDE, INSIDE] = 0.0
        for i, (weights, up) in enumerate(((field.emit, up_emit), (field.step, up_step))):
            up = up / n - shrink * weights
            state[i][0] = 0.9 * state[i][0] + 0.1 * up
            state[i][1] = 0.99 * state[i][1] + 0.01 * up * up
            mean, power = state[i][0] / (1 - 0.9**turn), state[i][1] / (1 - 0.99**turn)
            weights += rate * mean / (np.sqrt(power) + 1e-8)
        field.step[OUTSIDE, INSIDE] = -20.0
    return field


_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_SHAPES = (("", _ALNUM, 32), ("", _ALNUM + "+/", 40), ("", _ALNUM + "-_", 24), ("ghp_", _ALNUM, 36), ("sk-", _ALNUM, 40))
_SHAPES += (("eyJ", _ALNUM + "-_", 60), ("AKIA", _ALNUM[:26] + _ALNUM[52:], 16), ("", _ALNUM + "!$%&*+-_.@", 12))


def varied(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The text with each matched secret replaced by a made-up one of another shape, and where those stand.

    The patterns know few shapes; the field shall learn that it is the surroundings and the look that matter.
    """
    draw = np.random.default_rng(list(text[:64].encode("utf-8", "replace")))
    parts, at, length, places = [], 0, 0, []
    for _, end, _, secret in sorted(base_spans(text)):
        if secret < at:
            continue
        prefix, signs, size = _SHAPES[draw.integers(len(_SHAPES))]
        made = prefix + "".join(signs[i] for i in draw.integers(len(signs), size=size))
        length += secret - at
        parts += [text[at:secret], made]
        places.append((length, length + len(made)))
        length, at = length + len(made), end
    return "".join([*parts, text[at:]]), places


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of tokens around secrets, or spread over a text that has none, with their tags.

    A text with secrets is used twice, as it is and with its secrets varied.
    """
    tables, tags = [], []
    cases = [(t, [(secret, end) for _, end, _, secret in sorted(base_spans(t))]) for t in texts]
    cases += [varied(t) for t, places in cases if places]
    for text, places in cases:
        tokens = features([text])
        n = len(tokens.start)
        if not n:
            continue
        gold = np.zeros(n, dtype=np.int8)
        centres = []
        for secret, end in places:
            covered = np.flatnonzero((tokens.end > secret) & (tokens.start < end))
            if len(covered):
                gold[covered] = INSIDE
                gold[covered[0]] = BEGIN
                centres.append(int(covered[0]))
        middle = [int(x) for x in np.linspace(0, n - 1, 3)]
        for c in (centres[: WINDOWS - 1] + middle[1:2]) if centres else middle:
            a = max(0, min(c - WIDTH // 2, n - WIDTH))
            part = slice(a, min(n, a + WIDTH))
            size = part.stop - a
            table = np.zeros((WIDTH, len(GROUPS)), dtype=np.int32)
            tag = np.full(WIDTH, -1, dtype=np.int8)
            table[:size], tag[:size] = tokens.features[part], gold[part]
            tables.append(table)
            tags.append(tag)
    if not tables:
        return np.zeros((0, WIDTH, len(GROUPS)), np.int32), np.zeros((0, WIDTH), np.int8)
    return np.stack(tables), np.stack(tags)


def train(docs: DataFrame, *, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Field:
    """Fit the field on windows from at most ``sample`` documents with a pattern and ``sample`` of all.

    Which documents is decided by a hash of their key, so the same table gives the same field. Their windows (at most
    six of 33 tokens each) are made on the executors; only those reach the driver.
    """
    rows = docs.select(text_or_empty(text).alias("text"), F.xxhash64(F.col(key)).alias("order"), F.xxhash64(text).alias("hash"))
    # The sample is found by two hashes alone, 2 * sample rows in all, and its texts are fetched after that.
    hinted = rows.where(F.col("text").rlike(HINT)).select("order", "hash").orderBy("order", "hash").limit(sample)
    wanted = hinted.unionAll(rows.select("order", "hash").orderBy("order", "hash").limit(sample)).distinct()
    chosen = rows.join(F.broadcast(wanted), ["order", "hash"], "left_semi").dropDuplicates(["order", "hash"]).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        for batch in stretches(batches, text=0):
            table, tag = windows(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_pydict({"table": [t.tobytes() for t in table], "tag": [t.tobytes() for t in tag]})

    got = chosen.mapInArrow(run, "table binary, tag binary").collect()
    if not got:
        return Field.blank()
    got.sort()  # the same windows in the same order, whichever task made them
    table = np.stack([np.frombuffer(r[0], np.int32).reshape(WIDTH, -1) for r in got])
    return fit(table, np.stack([np.frombuffer(r[1], np.int8) for r in got]))


def _merged(found: list[tuple[int, int, str]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans cover together, in order."""
    starts, ends = [], []
    for a, b, _ in sorted(found):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def spans(texts: list[str], field: Field) -> list[list[tuple[int, int, str]]]:
    """All spans of each text by start, then kind: the base ones, and the tagged runs that touch none of them.

    A field that has seen no secret tags nothing.
    """
    found = [[(a, b, k) for a, b, k, _ in base_spans(t)] for t in texts]
    if field.emit.any():
        tokens = features(texts)
        tag = field.tags(tokens)
        taken = [_merged(f) for f in found]
        begins = np.flatnonzero((tag == BEGIN) | (tag == INSIDE) & (np.concatenate(([OUTSIDE], tag[:-1])) == OUTSIDE))
        for i in begins.tolist():
            j = i + 1
            while j < len(tag) and tag[j] == INSIDE and tokens.text[j] == tokens.text[i]:
                j += 1
            own, a, b = tokens.text[i], int(tokens.start[i]), int(tokens.end[j - 1])
            starts, ends = taken[own]
            before = bisect_left(starts, b)  # tagged runs do not touch each other
            if not before or ends[before - 1] <= a:
                found[own].append((a, b, "tagged"))
    return [sorted(f, key=lambda s: (s[0], KINDS.index(s[2]), s[1])) for f in found]


def _listed(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", field: Field | None = None) -> DataFrame:
    """Secrets of every whole text: ``key``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``.

    Spans are "kind:start:end" in code points, end exclusive, by start and then kind; an assign span is the whole match.
    Null texts count as empty and have no spans; repeated rows and null keys are kept; an empty table gives no rows
    and trains nothing.
    """
    field = train(docs, key=key, text=text) if field is None else field
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(field)
    shape = f"`{key}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        model = shared.value
        for batch in stretches(batches, limit=1 << 20):
            texts = batch.column(1).to_pylist()
            found = spans(texts, model)
            base = [[s for s in f if s[2] != "tagged"] for f in found]
            columns = [batch.column(0)]
            columns += [pa.array([sum(s[2] == k for s in f) for f in base], pa.int64()) for k in KINDS[:3]]
            columns += [pa.array([hex_sha256(_listed(f)) for f in base]), pa.array([_listed(f) for f in found])]
            names = [key, "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(key), text_or_empty(text).alias("__text")).mapInArrow(run, shape)


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with "[secret]" for each span; overlapping spans are replaced together."""
    parts, at = [], 0
    for a, b, _ in sorted(found):
        if b <= at:
            continue
        if a >= at:
            parts += [text[at:a], "[secret]"]
        at = b
    return "".join([*parts, text[at:]])


def without_secrets(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: str = "n_chars", field: Field | None = None
) -> DataFrame:
    """All rows of ``docs`` with every secret in ``text`` replaced; column ``length``, if there, counts again.

    Rows without a secret stay as they are, null texts too.
    """
    field = train(docs, key=key, text=text) if field is None else field
    shared = docs.sparkSession.sparkContext.broadcast(field)
    place = docs.columns.index(text)
    counted = docs.columns.index(length) if length in docs.columns else None

    def build():
        model = shared.value

        def clean(texts: list[str], batch: pa.RecordBatch) -> pa.RecordBatch:
            found = spans(texts, model)
            if not any(found):
                return batch
            new = [redact(t, f) if f else old for t, f, old in zip(texts, found, batch.column(place).to_pylist())]
            changed = batch.set_column(place, batch.schema.field(place), pa.array(new, batch.schema.field(place).type))
            if counted is None:
                return changed
            sizes = [len(t) if f else n for t, f, n in zip(new, found, batch.column(counted).to_pylist())]
            return changed.set_column(counted, batch.schema.field(counted), pa.array(sizes, batch.schema.field(counted).type))

        return clean

    return per_row(docs, text, build, limit=1 << 20)
