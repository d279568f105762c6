"""Row filters, column masks and hidden columns, applied before anyone sees a table.

Whatever cannot be applied as written denies access: an unknown kind of rule, a fact with no
path to the secured dimension, a principal without a mapping.
"""

from __future__ import annotations

from collections.abc import Collection, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motorpool.operators.joins import keep

ALL = "*"
# Fixed value of the library; give another literal where the table needs it.
MASK = "***@masked.invalid"

Branches = Sequence[tuple[str, str]]


def row_predicate(column: Column, groups: Collection[str], branches: Branches) -> Column:
    """The condition for a member of ``groups``.

    ``branches`` are ``(group, value)`` pairs tried in order: the first group the principal
    belongs to decides, ``"*"`` shows every row, no match shows none.
    """
    for group, value in branches:
        if group in groups:
            return F.lit(True) if value == ALL else column == value
    return F.lit(False)


def row_filter(df: DataFrame, column: str, groups: Collection[str], branches: Branches) -> DataFrame:
    return df.filter(row_predicate(F.col(column), groups, branches))


def mask(
    df: DataFrame, column: str, groups: Collection[str], allowed: Collection[str], literal: str = MASK
) -> DataFrame:
    """Replace the column by ``literal`` unless the principal is in an allowed group."""
    if set(groups) & set(allowed):
        return df
    return df.withColumn(column, F.lit(literal))


def hide(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def deny(df: DataFrame) -> DataFrame:
    return df.filter(F.lit(False))


def allowed_dim(dim: DataFrame, column: str, mapping: DataFrame, user: str) -> DataFrame:
    """Dimension rows that ``mapping`` (columns ``principal`` and ``column``) grants to the user."""
    granted = mapping.filter(F.col("principal") == user).select(column)
    return keep(dim, granted, column)


def rls(
    fact: DataFrame,
    fact_key: str | None,
    dim: DataFrame,
    dim_key: str,
    column: str,
    mapping: DataFrame,
    user: str,
) -> DataFrame:
    """Fact rows whose dimension row the user may see; none where the fact has no path."""
    if fact_key is None:
        return deny(fact)
    visible = allowed_dim(dim, column, mapping, user).select(F.col(dim_key).alias(fact_key))
    return keep(fact, visible, fact_key)


@dataclass(frozen=True)
class Policy:
    """One rule on one table. ``kind`` is ``row_filter``, ``mask``, ``hide`` or unknown."""

    table: str
    kind: str
    column: str
    branches: tuple[tuple[str, str], ...] = ()
    allowed: tuple[str, ...] = ()
    literal: str = MASK


@dataclass(frozen=True)
class Principal:
    name: str
    groups: frozenset[str] = field(default_factory=frozenset)


COLUMN_KINDS = ("mask", "hide")


def resolved(df: DataFrame, column: str) -> str | None:
    """The name under which the table has the column, as Spark resolves names; None if it has none or several."""
    exact = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    found = [c for c in df.columns if c == column or not exact and c.lower() == column.lower()]
    return found[0] if len(found) == 1 else None


def apply_policies(df: DataFrame, table: str, principal: Principal, policies: Iterable[Policy]) -> DataFrame:
    """Apply every rule on the table. Row filters see the values before any mask.

    A rule of unknown kind denies: no rows are shown. So does a rule of any kind on a column the
    table does not have, and its columns are still hidden or masked as far as they are there.
    Tables and columns are found as Spark finds them, by default without regard to case.
    """
    exact = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    rules = [p for p in policies if p.table == table or not exact and p.table.lower() == table.lower()]
    columns = [resolved(df, p.column) for p in rules]
    for p, column in zip(rules, columns):
        if column is None or p.kind not in ("row_filter", *COLUMN_KINDS):
            df = deny(df)
        elif p.kind == "row_filter":
            df = row_filter(df, column, principal.groups, p.branches)
    for p, column in zip(rules, columns):
        if column is None or column not in df.columns:
            continue
        if p.kind == "mask":
            df = mask(df, column, principal.groups, p.allowed, p.literal)
        elif p.kind == "hide" and not principal.groups & set(p.allowed):
            df = hide(df, [column])
    return df


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def create_sql_functions(
    spark: SparkSession,
    principal: Principal,
    branches: Branches,
    allowed: Collection[str],
    literal: str = MASK,
) -> None:
    """The same two rules as SQL functions: ``rentals_site_filter(city)`` and ``mask_email(email)``.

    The principal's groups are settled when the functions are made, so they inline into the
    query like any other expression.
    """
    decided = next((value for group, value in branches if group in principal.groups), None)
    test = "false" if decided is None else "true" if decided == ALL else f"site_city = {_quoted(decided)}"
    shown = "email" if principal.groups & set(allowed) else _quoted(literal)
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION rentals_site_filter(site_city STRING) RETURNS BOOLEAN RETURN " + test
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION mask_email(email STRING) RETURNS STRING RETURN " + shown)

