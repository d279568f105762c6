"""The words a byte-level tokenizer cuts a text into before it merges bytes.

A word is an optional blank with letters, with numbers or with other signs; white space that no word takes stands
alone, except that its last character goes to what follows; and the seven English endings after an apostrophe are
words of their own. Cut points are found for the whole text at once from the class of each character.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import regex

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
# White space as Unicode defines the property.
WHITE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# Fixed: the pattern of the tokenizer files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    found = np.fromiter(
        (kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), dtype=np.uint8, count=0x110000
    )
    found[list(WHITE)] = SPACE
    return found


@functools.cache
def _assigned() -> np.ndarray:
    """False for code points that this Python's Unicode tables do not know yet."""
    return np.fromiter((unicodedata.category(chr(c)) != "Cn" for c in range(0x110000)), dtype=bool, count=0x110000)


@functools.cache
def _pattern() -> regex.Pattern:
    return regex.compile(PATTERN)


class Unknown(ValueError):
    """The text holds code points newer than the Unicode tables at hand."""


def pretokens(text: str) -> list[str]:
    """The words of the text; joined they give it back. An empty text has none."""
    if not text:
        return []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if codes.max() > 0x7FF and not _assigned()[codes].all():
        raise Unknown
    if "'" in text:
        return _pattern().findall(text)
    kind = _classes()[codes]
    blank = codes == 32
    space = kind == SPACE
    cut = np.empty(len(codes), dtype=bool)
    cut[0] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:])
    # From white space to a word: a blank just before goes with the word, any other character stays by itself.
    into = np.flatnonzero(cut[1:] & space[:-1]) + 1
    cut[into[blank[into - 1]]] = False
    # The last character of a run of white space before a word is cut off the run.
    cut[into - 1] = True
    at = np.flatnonzero(cut).tolist()
    return [text[a:b] for a, b in zip(at, at[1:] + [len(text)])]
