"""Checks on tables: each returns rows that say what is wrong, or a small summary."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorpool.schemas import ENTITIES, Entity


class QualityError(AssertionError):
    """A required check failed."""


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def check_fks(
    tables: Mapping[str, DataFrame],
    relations: Sequence[tuple[str, str, str]],
    parent_keys: Mapping[str, str] | None = None,
) -> DataFrame:
    """Orphan rows per relation ``(child, column, parent)``; 0 where all resolve."""
    keys = parent_keys or {n: e.key for n, e in ENTITIES.items()}
    by_child: dict[str, list[int]] = {}
    for i, (child, _, _) in enumerate(relations):
        by_child.setdefault(child, []).append(i)

    def key_counts(child: str, numbers: list[int]) -> DataFrame:
        # All keys of a row in one pass, counted per relation and key before they are shuffled.
        pairs = [F.struct(F.lit(i).alias("relation"), _key_text(tables[child], relations[i][1]).alias("key")) for i in numbers]
        found = tables[child].select(F.inline(F.array(*pairs))).filter("key IS NOT NULL")
        return found.groupBy("relation", "key").agg(F.count("*").alias("child_rows"))

    parents = sorted({p for _, _, p in relations})
    number = {p: n for n, p in enumerate(parents)}
    known = _union(
        tables[p].select(F.lit(number[p]).alias("parent"), _key_text(tables[p], keys[p]).alias("key")) for p in parents
    )
    of_relation = F.array(*[F.lit(number[p]) for _, _, p in relations])
    children = _union(key_counts(c, n) for c, n in by_child.items())
    tagged = children.withColumn("parent", F.element_at(of_relation, F.col("relation") + 1))
    missing = tagged.join(known, ["parent", "key"], "left_anti")
    zeros = tables[parents[0]].sparkSession.range(len(relations)).select(F.col("id").cast("int").alias("relation"), F.lit(0).cast("long").alias("child_rows"))
    total = missing.select("relation", "child_rows").unionByName(zeros).groupBy("relation").agg(F.sum("child_rows").alias("orphans"))
    names = [F.array(*[F.lit(r[k]) for r in relations]) for k in range(3)]
    columns = [F.element_at(n, F.col("relation") + 1).alias(c) for n, c in zip(names, ("child", "column", "parent"))]
    return total.select(*columns, "orphans")


def _key_text(df: DataFrame, column: str) -> Column:
    """Keys as text, so that those of all relations fit one column; whole numbers of any width agree."""
    return F.col(column).cast("string")


def require_fks(tables: Mapping[str, DataFrame], relations: Sequence[tuple[str, str, str]]) -> None:
    """Stop with the list of broken relations, if any."""
    broken = check_fks(tables, relations).filter("orphans > 0").collect()
    if broken:
        lines = [f"{r.child}.{r.column} -> {r.parent}: {r.orphans} orphans" for r in broken]
        raise QualityError("; ".join(lines))


def entity_relations(names: Iterable[str]) -> list[tuple[str, str, str]]:
    """All declared references among the named entities."""
    known = set(names)
    return [(n, c, p) for n in ENTITIES if n in known for c, p in ENTITIES[n].refs.items() if p in known]


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def check_non_empty(tables: Mapping[str, DataFrame]) -> None:
    """Stop if any table has no row; reads no further than the first one."""
    empty = [name for name, df in tables.items() if is_empty(df)]
    if empty:
        raise QualityError("empty: " + ", ".join(empty))


def check_pk(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """One row: how many rows, null keys, keys used more than once and surplus rows."""
    keys = [key] if isinstance(key, str) else list(key)
    has_null = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    per_key = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    repeated = ~has_null & (F.col("_n") > 1)
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(has_null, F.col("_n"))), F.lit(0)).alias("null_keys"),
        F.count_if(repeated).alias("repeated_keys"),
        F.coalesce(F.sum(F.when(repeated, F.col("_n") - 1)), F.lit(0)).alias("surplus_rows"),
    )


Contract = Mapping[str, Column]


def contract_of(entity: Entity, columns: Iterable[str] | None = None) -> dict[str, Column]:
    """Violation conditions of an entity by rule name: missing values and unknown codes.

    A required column that the table (``columns``) lacks is violated by every row, under ``missing:``.
    """
    present = set(entity.columns if columns is None else columns)
    rules = {
        f"required:{c}" if c in present else f"missing:{c}": F.col(c).isNull() if c in present else F.lit(True)
        for c in entity.required
    }
    for column, allowed in entity.enums.items():
        if column in present:
            rules[f"enum:{column}"] = ~F.col(column).isin(*allowed)
    return rules


def type_rules(entity: Entity, columns: Iterable[str]) -> dict[str, Column]:
    """For raw columns: a value is there but does not parse as the declared type, or is no number."""

    def broken(column: str, dtype: str) -> Column:
        parsed = F.col(column).cast("string").try_cast(dtype)
        bad = parsed.isNull()
        if dtype == "double":
            bad = bad | F.isnan(parsed)
        return F.col(column).isNotNull() & bad

    present = set(columns)
    return {f"type:{c}": broken(c, t) for c, t in entity.types.items() if c in present and t != "string"}


def validate(df: DataFrame, contract: Contract) -> DataFrame:
    """Violations per rule, all counted in one pass over the rows."""
    counted = df.agg(*[F.count_if(cond).alias(f"r{i}") for i, cond in enumerate(contract.values())])
    entries = [
        F.struct(F.lit(rule).alias("rule"), F.col(f"r{i}").alias("violations")) for i, rule in enumerate(contract)
    ]
    return counted.select(F.inline(F.array(*entries)))


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-free hash of the content: equal tables agree on both."""
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    return df.agg(
        F.count("*").alias("rows"),
        F.bit_xor(row_hash).alias("hash_xor"),
        F.sum(row_hash.cast("decimal(20,0)")).alias("hash_sum"),
    )


# Parts a table is cut into by hash when it is compared by digests.
DIGEST_BUCKETS = 4096


def digests(df: DataFrame, by: Sequence[str] = (), buckets: int = DIGEST_BUCKETS) -> DataFrame:
    """Per hash bucket of ``by`` (of whole rows if empty): rows and two order-free hashes of their content.

    Rows are added up where they are read, so each task sends at most one row per bucket.
    """
    columns = [F.col(f"`{c}`") for c in sorted(df.columns)]
    bucket = F.pmod(F.xxhash64(F.lit(3), *([F.col(f"`{c}`") for c in by] or columns)), F.lit(buckets)).cast("int")
    return df.groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.bit_xor(F.xxhash64(*columns)).alias("hash_xor"),
        F.sum(F.xxhash64(F.lit(7), *columns).cast("decimal(20,0)")).alias("hash_sum"),
    )


def differing_buckets(left: DataFrame, right: DataFrame, by: Sequence[str] = (), buckets: int = DIGEST_BUCKETS) -> DataFrame:
    """The buckets in which two tables differ, at most ``buckets`` rows."""
    sides = [digests(df, by, buckets).withColumn("sides", F.lit(1)) for df in (left, right)]
    both = sides[0].unionByName(sides[1]).groupBy("bucket", "rows", "hash_xor", "hash_sum").agg(F.sum("sides").alias("sides"))
    return both.where("sides = 1").select("bucket").distinct()


def same_rows(left: DataFrame, right: DataFrame, by: Sequence[str] = (), buckets: int = DIGEST_BUCKETS) -> DataFrame:
    """Rows that one side has more often than the other; empty when both are equal.

    Digests of hash buckets are compared first, and rows only of the buckets that differ: equal tables exchange their
    digests alone. With ``by`` (the key of both tables) a changed row marks one bucket, else two.
    """
    right = right.select(*left.columns)
    # One small number for each bucket that differs: never more than ``buckets``, whatever the tables hold. The limit cuts
    # nothing; it tells Spark so before it plans the joins.
    wanted = differing_buckets(left, right, by, buckets).withColumnRenamed("bucket", "_bucket").limit(buckets)
    columns = [F.col(f"`{c}`") for c in by or sorted(left.columns)]
    own = F.pmod(F.xxhash64(F.lit(3), *columns), F.lit(buckets)).cast("int") == F.col("_bucket")
    a, b = (df.join(wanted, own, "left_semi") for df in (left, right))
    only_left = a.exceptAll(b).withColumn("side", F.lit("left"))
    return only_left.unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: rows on either side, and how many of them the other side lacks."""
    right = right.select(*left.columns)
    sides = left.withColumns({"_l": F.lit(1), "_r": F.lit(0)}).unionByName(
        right.withColumns({"_l": F.lit(0), "_r": F.lit(1)})
    )
    per_row = sides.groupBy(*left.columns).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))

    def total(column: Column, name: str) -> Column:
        return F.coalesce(F.sum(column), F.lit(0)).alias(name)

    return per_row.agg(
        total(F.col("_l"), "left_rows"),
        total(F.col("_r"), "right_rows"),
        total(F.abs(F.col("_l") - F.col("_r")), "differing_rows"),
    )


def assert_same(left: DataFrame, right: DataFrame) -> None:
    found = same_rows(left, right).limit(5).collect()
    if found:
        raise QualityError(f"results differ, for example {found}")


def reconcile(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, Column],
    tolerance: float = 0.0,
) -> DataFrame:
    """Compare totals of two layers by key; both sides are aggregated before they meet.

    One row per key and measure with both totals, their difference and whether it is within
    tolerance. A key that one side lacks is reported as not matching.
    """

    def totals(df: DataFrame, side: str) -> DataFrame:
        named = [m.cast("double").alias(f"{side}_{n}") for n, m in measures.items()]
        return df.groupBy(*keys).agg(*named).withColumn(f"_{side}", F.lit(True))

    a, b = totals(left, "left").alias("a"), totals(right, "right").alias("b")
    same_key = reduce(Column.__and__, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    both = a.join(b, same_key, "full")
    entries = []
    for name in measures:
        lhs, rhs = F.col(f"left_{name}"), F.col(f"right_{name}")
        gap = lhs - rhs
        # Both sides present and both null counts as equal.
        matches = (lhs.isNull() & rhs.isNull()) | F.coalesce(F.abs(gap) <= tolerance, F.lit(False))
        entries.append(
            F.struct(
                F.lit(name).alias("measure"),
                lhs.alias("left_total"),
                rhs.alias("right_total"),
                gap.alias("difference"),
                (matches & F.col("_left").isNotNull() & F.col("_right").isNotNull()).alias("matches"),
            )
        )
    key_cols = [F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys]
    return both.select(*key_cols, F.inline(F.array(*entries)))


@dataclass(frozen=True)
class Pattern:
    """A kind of personal data. ``literal`` occurs in every match and is looked for first."""

    regex: str
    literal: str

    def found_in(self, column: Column) -> Column:
        return column.contains(self.literal) & column.rlike(self.regex)


# Patterns of personal data.
PII_PATTERNS = {
    "email": Pattern(r"[A-Za-z0-9._%+-]@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "@"),
    "phone": Pattern(r"[0-9]-[0-9]{3}-[0-9]{3}-[0-9]{4}", "-"),
}


def classify_pii(
    df: DataFrame, patterns: Mapping[str, Pattern] = PII_PATTERNS, min_ratio: float = 0.5
) -> DataFrame:
    """Per text column and kind of personal data: how many values hold it, and the verdict.

    Whole values are searched, all columns and kinds in one pass.
    """
    texts = [c for c, t in df.dtypes if t == "string"]
    cells = [(c, kind, p.found_in(F.col(c))) for c in texts for kind, p in patterns.items()]
    counted = df.agg(
        *[F.count(F.col(c)).alias(f"n_{c}") for c in texts],
        *[F.count_if(found).alias(f"m{i}") for i, (_, _, found) in enumerate(cells)],
    )
    entries = []
    for i, (c, kind, _) in enumerate(cells):
        ratio = F.col(f"m{i}") / F.nullif(F.col(f"n_{c}"), F.lit(0))
        entries.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(kind).alias("kind"),
                F.col(f"n_{c}").alias("values"),
                F.col(f"m{i}").alias("matches"),
                F.round(ratio, 4).alias("ratio"),
                F.coalesce(ratio >= min_ratio, F.lit(False)).alias("is_pii"),
            )
        )
    return counted.select(F.inline(F.array(*entries)))
