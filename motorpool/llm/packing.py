"""Token sequences of fixed size from pieces of documents, by vector bin packing.

A piece takes tokens, one segment and loss-bearing tokens of its sequence, and a sequence has a limit for each. Every
task packs what it reads. It keeps a pool of pieces sorted into classes of equal demand; for the open sequence it takes
the class with the largest dot product of its demand and what the sequence has left, both as shares of the limits,
among the classes that fit. When none fits, one piece is cut so that it fills the sequence. A sequence that no cut can
fill is cut back to a power of two, which needs no padding either, and the rest returns to the pool.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorpool.llm.bpe import byte_signs
from motorpool.llm.common import claim, keeps, stretches, text_or_empty
from motorpool.llm.pretokens import PATTERN, _assigned

# Tokens a task holds back, so that later sequences still have pieces to choose from.
RESERVE = 256 * 1024
END = 0


@dataclass(frozen=True)
class Limits:
    """Of one sequence: tokens, segments (pieces), and tokens that bear loss."""

    tokens: int = 1024
    segments: int = 128
    loss: int = 1024


class Ids:
    """Token ids of a byte-level BPE file as the tokenizers library gives them, as arrays.

    Merging by the rank of the merged token gives what merging by pairs gives, since every token of such a file is the
    one its own merges lead to. Texts with code points newer than the Unicode tables at hand go to the library itself.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        signs, model = byte_signs(), spec["model"]
        if spec.get("normalizer") or model.get("type") != "BPE" or model.get("ignore_merges"):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        raw = {t: bytes(signs[c] for c in t) for t in model["vocab"] if all(c in signs for c in t)}
        order = [t for t in raw if len(raw[t]) == 1]
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            order.append(left + right)
        order = list(dict.fromkeys(order))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        own = {s: len(order) + i for i, s in enumerate(self.special)}
        self.names = np.array([model["vocab"][t] for t in order] + list(self.special.values()), np.uint32)
        ranks = {raw[t]: i for i, t in enumerate(order)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=own)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()

    def of(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if not text.isascii():
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            if not _assigned()[codes].all():
                return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.names[self.encoding.encode_to_numpy(text, allowed_special="all", disallowed_special=())]


@functools.lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    """One for each file and worker process."""
    return Ids(path)


keeps(__name__, ids_of.cache_clear)


@dataclass(frozen=True)
class Piece:
    """Ids ``start`` to ``start + length`` of the item with number ``item``, the first ``free`` of which bear no loss."""

    item: int
    start: int
    length: int
    free: int

    def loss(self, length: int | None = None) -> int:
        """Tokens of its first ``length`` that bear loss; the first of a piece has nothing before it to learn from."""
        return max(0, self.start + (self.length if length is None else length) - max(self.start + 1, self.free))

    def most(self, tokens: int, loss: int) -> int:
        """How many of its tokens fit."""
        return min(self.length, tokens, max(1, self.free - self.start) + loss)

    def cut(self, length: int) -> tuple[Piece, Piece]:
        return Piece(self.item, self.start, length, self.free), Piece(self.item, self.start + length, self.length - length, self.free)


class Pool:
    """Pieces by class of equal demand, and the sequences made of them."""

    def __init__(self, limits: Limits) -> None:
        self.limits = limits
        self.pieces: dict[tuple[int, int], list[Piece]] = {}
        self.place: dict[tuple[int, int], int] = {}
        self.demand = np.zeros((3, 64))
        self.count = np.zeros(64, np.int64)
        self.tokens = 0

    def put(self, piece: Piece) -> None:
        name = (piece.length, piece.loss())
        if name not in self.place:
            at = self.place[name] = len(self.place)
            if at == len(self.count):
                self.demand = np.concatenate((self.demand, np.zeros_like(self.demand)), axis=1)
                self.count = np.concatenate((self.count, np.zeros_like(self.count)))
            self.demand[:, at] = piece.length, 1, name[1]
            self.pieces[name] = []
        self.pieces[name].append(piece)
        self.count[self.place[name]] += 1
        self.tokens += piece.length

    def take(self, at: int) -> Piece:
        piece = self.pieces[int(self.demand[0, at]), int(self.demand[2, at])].pop()
        self.count[at] -= 1
        self.tokens -= piece.length
        return piece

    def best(self, left: np.ndarray) -> int | None:
        """The class that fits and lies most along what is left."""
        n = len(self.place)
        demand = self.demand[:, :n]
        fits = (self.count[:n] > 0) & (demand <= left[:, None]).all(axis=0)
        if not fits.any():
            return None
        limits = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], float)
        return int(np.where(fits, (left / limits**2) @ demand, -1.0).argmax())

    def longest(self) -> int:
        n = len(self.place)
        return int(np.where(self.count[:n] > 0, self.demand[0, :n], -1.0).argmax())

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Puts a piece into the pool, but for the full sequences it makes alone."""
        while piece.length >= self.limits.tokens and piece.most(self.limits.tokens, self.limits.loss) == self.limits.tokens:
            whole, piece = piece.cut(self.limits.tokens)
            yield [whole]
        if piece.length:
            self.put(piece)

    def sequence(self) -> list[Piece]:
        """The next sequence; the pool is not empty."""
        made: list[Piece] = []
        left = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], float)
        while self.tokens and left[0] > 0 and left[1] > 0:
            at = self.best(left)
            # The last segment has to fill what is left.
            if at is None or left[1] == 1 and self.demand[0, at] < left[0]:
                at = self.longest()
            piece = self.take(at)
            length = piece.most(int(left[0]), int(left[2]))
            if length < piece.length:
                piece, rest = piece.cut(length)
                self.put(rest)
                if length < left[0] and left[1] > 1 and left[2] == piece.loss():
                    left[1] = 1  # no loss is left: only single tokens would follow
            made.append(piece)
            left -= (piece.length, 1, piece.loss())
        total = sum(p.length for p in made)
        excess = 0 if total == self.limits.tokens else total - (1 << total.bit_length() - 1)
        while excess:
            piece = made.pop()
            back = min(excess, piece.length)
            if back < piece.length:
                kept, piece = piece.cut(piece.length - back)
                made.append(kept)
            self.put(piece)
            excess -= back
        return made


def packed(items: Iterator[tuple[int, int, int]], limits: Limits, reserve: int, pool: Pool) -> Iterator[list[Piece]]:
    """Sequences of items (number, tokens, tokens without loss), all but ``reserve`` tokens of the pool."""
    for item, length, free in items:
        yield from pool.add(Piece(item, 0, length, free))
    while pool.tokens > reserve:
        yield pool.sequence()


_PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(
    docs: DataFrame, tokenizer_path: str, limits: Limits = Limits(), *,
    key: str = "doc_id", text: str = "text", prompt: str | None = None, end: int | None = END, reserve: int = RESERVE,
    ids: bool = False,
) -> DataFrame:
    """One row per piece: ``key``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id`` and ``offset``.

    An item is a row: its prompt, if a column is named for it, the text, and the id ``end`` unless that is None. The
    prompt bears no loss, nor does the first token of a piece; all others do. Pieces of a sequence lie one after
    another from 0 without gaps; each id of an item is in exactly one piece. No sequence exceeds a limit, and its
    length is the limit of tokens or a power of two, so none needs padding. With ``ids`` the ids of the piece follow.
    ``sequence_id`` is unique in the table and says nothing else. Null texts are empty; with ``end`` they are one
    token, without it they have no piece. Null and repeated keys are items like any other, very long texts are cut,
    an empty table gives no rows. Nothing is shuffled: each task packs the rows it reads and holds a stretch of texts
    and ``reserve`` tokens at a time.
    """
    narrow = docs.select(
        F.col(key).alias("__key"), text_or_empty(text).alias("__text"), text_or_empty(prompt).alias("__prompt") if prompt else F.lit("").alias("__prompt")
    )
    kind = narrow.schema["__key"].dataType.simpleString()
    schema = docs.sparkSession.createDataFrame([], f"`{key}` {kind}, {_PIECES}{', ids array<long>' * ids}").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        from pyspark import TaskContext

        of = ids_of(tokenizer_path).of
        pool, number = Pool(limits), TaskContext.get().partitionId() << 40
        held: dict[int, list] = {}  # number -> key, ids, tokens not yet in a sequence
        count = 0

        def rows(sequences: Iterator[list[Piece]], keys: pa.DataType) -> Iterator[pa.RecordBatch]:
            nonlocal number
            columns: list[list] = [[] for _ in schema.fields]
            for pieces in sequences:
                offset = 0
                for p in pieces:
                    item = held[p.item]
                    part = item[1][p.start : p.start + p.length]
                    row = (item[0], p.start, p.length, zlib.crc32(part.astype("<u4").tobytes()), len(item[1]), number, offset)
                    for column, value in zip(columns, (*row, part) if ids else row):
                        column.append(value)
                    offset += p.length
                    item[2] -= p.length
                    if not item[2]:
                        del held[p.item]
                number += 1
            if columns[0]:
                kinds = [keys, *[pa.int64()] * 6, *[pa.list_(pa.int64())] * ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.name for f in schema.fields])

        keys = pa.null()
        for batch in stretches(batches):
            keys, fresh = batch.column(0).type, []
            for name, t, before in zip(*(batch.column(i).to_pylist() for i in range(3))):
                first, rest = (of(before) if before else np.zeros(0, np.uint32)), of(t)
                whole = np.concatenate((first, rest, np.array([] if end is None else [end], np.uint32)))
                if len(whole):
                    held[count] = [name, whole, len(whole)]
                    fresh.append((count, len(whole), len(first)))
                    count += 1
            yield from rows(packed(iter(fresh), limits, reserve, pool), keys)
        yield from rows(packed(iter(()), limits, 0, pool), keys)

    return narrow.mapInArrow(run, schema)

