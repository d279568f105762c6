"""Queries that SQL can express, against it."""

from __future__ import annotations

import pytest

from checks.compare import differences, duck, plain
from llm_samples import DATA
from motorpool.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", list(SQL))
def test_query_agrees_with_sql(spark, name):
    got = plain(QUERIES[name](spark, DATA).toArrow())
    assert differences(got, plain(duck(DATA).execute(SQL[name]).to_arrow_table())) == []
