"""Bring a Spark result and a DuckDB result into one form and compare them."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

Plain = tuple[dict[str, str], list[tuple]]


def duck(directory: str) -> duckdb.DuckDBPyConnection:
    """A connection with the tables of a data directory as views."""
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{directory}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{directory}/{t}.parquet'")
    return con


def plain(table: pa.Table) -> Plain:
    """Column types and sorted rows, columns in name order."""
    names = sorted(table.column_names)
    table = table.select(names)
    kinds = {n: str(t).replace("large_", "") for n, t in zip(names, table.schema.types)}
    rows = sorted(zip(*[c.to_pylist() for c in table.columns]), key=repr)
    return kinds, rows


def differences(got: Plain, want: Plain, shown: int = 3) -> list[str]:
    """What differs, in words; empty when the two agree."""
    (got_kinds, got_rows), (want_kinds, want_rows) = got, want
    found = [
        f"{c}: spark {got_kinds.get(c)}, sql {want_kinds.get(c)}"
        for c in sorted(set(got_kinds) | set(want_kinds))
        if got_kinds.get(c) != want_kinds.get(c)
    ]
    if len(got_rows) != len(want_rows):
        found.append(f"{len(got_rows)} rows, sql {len(want_rows)}")
    unequal = [(g, w) for g, w in zip(got_rows, want_rows) if g != w]
    if unequal:
        found.append(f"{len(unequal)} rows differ in {list(got_kinds)}")
        found += [f"spark {g}\n     sql   {w}" for g, w in unequal[:shown]]
    return found
