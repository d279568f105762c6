"""Odd rows that every operator has to survive."""

from __future__ import annotations

import pytest
from llm_samples import ODD_TEXTS, PROSE

from motorpool.llm.common import prepared


@pytest.fixture(scope="session", autouse=True)
def importable(spark):
    prepared(spark)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, repeated rows and keys, very long texts, and columns whose names an operator might use."""
    rows = [(i if i != 3 else None, t, "en" if i % 2 else None, i) for i, t in enumerate(ODD_TEXTS)]
    rows += [(5, PROSE, "en", 5), (6, "another text", None, None), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").selectExpr(
        "*", "'k' as key", "7 as sid", "'u' as id", "'t' as label", "1 as component", "2 as size", "3 as word"
    )
