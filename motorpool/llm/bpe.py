"""Byte-pair encoding and decoding by dynamic programming over prefixes.

For every prefix of a word exactly one token can stand last in its encoding. An automaton over the vocabulary reports
all tokens that end at a byte; a token stands last there if it begins the word, or if it may follow the last token of
the prefix before it. Two tokens may stand side by side if no merge of the tokenizer reaches across their border before
both are complete. Back-pointers from the end of the word give its ids: the same ids that merging pair by pair gives.
"""

from __future__ import annotations

import functools
import json
from array import array
from collections.abc import Iterable

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from motorpool.llm.common import hex_sha256, keeps, per_text
from motorpool.llm.pretokens import Unknown, pretokens

NEVER = 1 << 62
# Entries a worker keeps of words and of pairs before it starts anew.
CACHE = 400_000
# Words a worker keeps as packed ids.
PACKED = 100_000


def byte_signs() -> dict[str, int]:
    """The printable sign for each byte in the vocabulary file: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixEncoder:
    """Encoder and decoder of one tokenizer file (byte-level BPE without a normaliser)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        signs, model = byte_signs(), spec["model"]
        if spec.get("normalizer") or model.get("type") != "BPE" or model.get("ignore_merges"):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        raw = {t: bytes(signs[c] for c in t) for t in model["vocab"] if all(c in signs for c in t)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.ids = {raw[t]: i for t, i in model["vocab"].items() if t in raw and t not in self.special}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: c.encode() for c, i in self.special.items()}
        # made[id] = (rank, left, right); joined[left, right] = rank. Single bytes come before every merge.
        self.made: dict[int, tuple[int, int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = self.ids[raw[left]], self.ids[raw[right]]
            self.joined[a, b] = rank
            self.made.setdefault(self.ids[raw[left] + raw[right]], (rank, a, b))
        if any(self._rank(a) > rank or self._rank(b) > rank for rank, a, b in self.made.values()):
            raise ValueError(f"{path}: a merge uses a token that a later merge makes")
        self.automaton = ahocorasick.Automaton()
        for b, i in self.ids.items():
            if len(b) == 1 or i in self.made:
                self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, tuple[str, int, bytes]] = {}
        self.packed: dict[str, bytes] = {}

    def _rank(self, token: int) -> int:
        return self.made[token][0] if token in self.made else -1

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, are the encoding of their bytes.

        Walks the pieces that touch the border, from the finished tokens back to single bytes. A piece lives from the
        merge that makes it to the merge that takes it in; a merge across the border wins if it comes while both
        pieces live. At equal rank the merge further left comes first.
        """
        left_end = right_end = NEVER
        while True:
            rank = self.joined.get((left, right))
            if rank is not None and rank < left_end and rank <= right_end:
                return False
            born_left, born_right = self._rank(left), self._rank(right)
            if born_left < 0 and born_right < 0:
                return True
            if born_left > born_right:
                left_end, left = born_left, self.made[left][2]
            elif born_right > born_left:
                right_end, right = born_right, self.made[right][1]
            else:  # the same merge made both: the left one a moment earlier
                right_end, right = born_right, self.made[right][1]

    def word(self, word: str) -> list[int]:
        """Ids of one word."""
        data = word.encode("utf-8", "surrogatepass")
        whole = self.ids.get(data)
        if whole is not None and len(data) == 1:
            return [whole]
        last: list[int] = [-1] * (len(data) + 1)
        back = [0] * (len(data) + 1)
        pairs, done = self.pairs, 0
        for end, (token, size) in self.automaton.iter(data.decode("latin-1")):
            end += 1
            if done == end:
                continue
            start = end - size
            if start:
                before = last[start]
                if before < 0:
                    continue
                key = before << 20 | token
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) > CACHE:
                        pairs.clear()
                    fits = pairs[key] = self.compatible(before, token)
                if not fits:
                    continue
            last[end], back[end], done = token, start, end
        ids, at = [], len(data)
        while at:
            ids.append(last[at])
            at = back[at]
        return ids[::-1]

    def known(self, word: str) -> tuple[str, int, bytes]:
        """Ids as text, their number and the decoded bytes of one word, kept for the next time."""
        found = self.words.get(word)
        if found is None:
            ids = self.word(word)
            if len(self.words) > CACHE:
                self.words.clear()
            found = self.words[word] = (",".join(map(str, ids)), len(ids), b"".join(map(self.bytes_of.__getitem__, ids)))
        return found

    def pieces(self, text: str) -> Iterable[tuple[str, int | None]]:
        """The text cut at special strings: (ordinary text, None) or (special string, id)."""
        if not any(s in text for s in self.special):
            return [(text, None)]
        found, start, i = [], 0, 0
        by_length = sorted(self.special, key=len, reverse=True)
        while i < len(text):
            hit = next((s for s in by_length if text.startswith(s, i)), None)
            if hit is None:
                i += 1
                continue
            found += [(text[start:i], None), (hit, self.special[hit])]
            i += len(hit)
            start = i
        return [*found, (text[start:], None)]

    def cut(self, text: str) -> list[str]:
        try:
            return pretokens(text)
        except Unknown:
            return [text[a:b] for _, (a, b) in _library_splitter().pre_tokenize_str(text)]

    def encoded(self, text: str) -> list[tuple[str, int, bytes]]:
        found: list[tuple[str, int, bytes]] = []
        words = self.words
        for piece, special in self.pieces(text):
            if special is not None:
                found.append((str(special), 1, self.bytes_of[special]))
            elif piece:
                found += [words.get(w) or self.known(w) for w in self.cut(piece)]
        return found

    def pack(self, word: str) -> bytes:
        """Ids of one word as 32-bit numbers, kept for the next time."""
        found = self.packed.get(word)
        if found is None:
            if len(self.packed) >= PACKED:
                self.packed.clear()
            found = self.packed[word] = array("i", self.word(word)).tobytes()
        return found

    def numbers(self, text: str) -> np.ndarray:
        """Ids of a text without what decoding needs: four bytes an id, and no text of them is kept."""
        found, packed = [], self.packed
        for piece, special in self.pieces(text):
            if special is not None:
                found.append(array("i", [special]).tobytes())
            elif piece:
                found += [packed.get(w) or self.pack(w) for w in self.cut(piece)]
        return np.frombuffer(b"".join(found), np.int32)

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, n, _ in self.encoded(text) if n for i in ids.split(",")]

    def decode(self, ids: Iterable[int]) -> str:
        """Text of the ids; ids outside the vocabulary say nothing, bytes that are no UTF-8 become U+FFFD."""
        return b"".join(self.bytes_of.get(i, b"") for i in ids).decode("utf-8", "replace")


@functools.cache
def _library_splitter():
    from tokenizers.pre_tokenizers import ByteLevel

    return ByteLevel(add_prefix_space=False, use_regex=True)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> PrefixEncoder:
    """One encoder for each file and worker process."""
    return PrefixEncoder(path)


keeps(__name__, encoder.cache_clear)


def encode_documents(docs: DataFrame, tokenizer_path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids again, and return ``key``, ``ids`` and ``decoded``.

    A null text counts as empty and has no ids. Rows are not merged: repeated rows give repeated results. Columns
    other than key and text are not read.
    """

    def build():
        of = encoder(tokenizer_path)

        def row(t: str) -> tuple:
            parts = of.encoded(t)
            return [int(i) for p in parts for i in p[0].split(",")], b"".join([p[2] for p in parts]).decode("utf-8", "replace")

        return row

    return per_text(docs, key, text, "ids array<int>, decoded string", build)


def encode_ids(docs: DataFrame, tokenizer_path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids`` of every whole text, as above, without decoding them."""

    def build():
        of = encoder(tokenizer_path)
        return lambda t: (of.numbers(t),)

    return per_text(docs, key, text, "ids array<int>", build)


def encoding_digests(docs: DataFrame, tokenizer_path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_tokens`` and SHA-256 of the ids (decimal, joined by commas) and of the decoded text.

    The ids and the text go no further than the task that makes them. Null, empty and repeated rows as above.
    """

    def build():
        of = encoder(tokenizer_path)

        def row(t: str) -> tuple:
            parts = of.encoded(t)
            ids = ",".join([p[0] for p in parts])
            decoded = b"".join([p[2] for p in parts]).decode("utf-8", "replace")
            return sum([p[1] for p in parts]), hex_sha256(ids), hex_sha256(decoded)

        return row

    return per_text(docs, key, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", build)
