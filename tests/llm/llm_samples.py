"""Texts and paths the tests share."""

from __future__ import annotations

import public_tokenizers

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DATA = "/root/testdata/sf0.001"

PROSE = "the cat sat on the mat and looked at the dog while rain fell over the old town near the river bank"
ODD_TEXTS = [
    None,
    "",
    " \n\t ",
    "x",
    "two words",
    PROSE,
    PROSE,
    PROSE.upper(),
    "é漢字 😀👍🏽 ﷺ  　   ‍ z\x00y\x1cq",
    "a" * 20000,
    "long " * 30000,
    "it's <|endoftext|> 'we'll' <|endoftext|>",
    'token = "0123456789abcdef01234567"',
]
