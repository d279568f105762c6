"""Worker processes let go of what another operator has cached."""

from __future__ import annotations

from motorpool.llm import bpe, common
from llm_samples import TOKENIZER


def test_a_task_of_another_operator_frees_the_cache(monkeypatch):
    monkeypatch.setattr(common, "_owner", [""])
    common.claim("motorpool.llm.bpe")
    first = bpe.encoder(TOKENIZER)
    common.claim("motorpool.llm.bpe")
    assert bpe.encoder(TOKENIZER) is first
    common.claim("motorpool.llm.shingle_join")
    assert bpe.encoder.cache_info().currsize == 0
