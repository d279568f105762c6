"""Joins shared by the gold tables, the semantic model and the checks.

Nothing here forces a broadcast. Spark broadcasts a side whose size it knows to be under its
threshold, adaptive execution does the same with the measured size, and splits skewed
partitions of the larger side otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_SLICES = 64


def role_dim(dim: DataFrame, names: dict[str, str]) -> DataFrame:
    """A dimension in one of its roles: ``names`` maps its columns to the names in that role."""
    return dim.select(*[F.col(c).alias(alias) for c, alias in names.items()])


def lookup(fact: DataFrame, dim: DataFrame, on: str, spread_nulls_by: str | None = None) -> DataFrame:
    """Left join a fact to a dimension with unique key ``on``.

    A null key matches nothing, yet in a shuffled join all nulls meet in one task. With
    ``spread_nulls_by`` (any well-spread column of the fact) they are dealt over many tasks.
    """
    if spread_nulls_by is None:
        return fact.join(dim, on, "left")
    bucket = F.pmod(F.xxhash64(spread_nulls_by), F.lit(NULL_SLICES))
    dealt = fact.withColumn("_slice", F.when(F.col(on).isNull(), bucket).otherwise(F.lit(0)))
    return dealt.join(dim.withColumn("_slice", F.lit(0).cast("long")), [on, "_slice"], "left").drop("_slice")


def keep(df: DataFrame, wanted: DataFrame, on: str) -> DataFrame:
    """Rows whose key is among the wanted ones, columns in their old order."""
    return df.join(wanted, on, "left_semi").select(*df.columns)


def orphan_keys(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child keys without a parent, with the number of child rows under each.

    The child is reduced to its distinct keys before it meets the parent, so a key that fills a
    third of the child costs one row per map task.
    """
    counts = child.filter(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("orphan_key"))
    parents = parent.select(F.col(parent_key).alias("orphan_key"))
    return counts.agg(F.count("*").alias("child_rows")).join(parents, "orphan_key", "left_anti")


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose non-null key has no parent."""
    missing = orphan_keys(child, child_key, parent, parent_key).select(F.col("orphan_key").alias(child_key))
    return keep(child, missing, child_key)


def fk_resolves(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """One row: child rows, rows whose key resolves, orphan rows and null keys."""
    per_key = child.groupBy(F.col(child_key).alias("_key")).agg(F.count("*").alias("_rows"))
    parents = parent.select(F.col(parent_key).alias("_key")).distinct().withColumn("_known", F.lit(True))
    known, missing = F.col("_known").isNotNull(), F.col("_key").isNull()
    return per_key.join(parents, "_key", "left").agg(
        _rows_where(F.lit(True)).alias("child_rows"),
        _rows_where(known).alias("resolved_rows"),
        _rows_where(~known & ~missing).alias("orphan_rows"),
        _rows_where(missing).alias("null_keys"),
    )


def _rows_where(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("_rows")).otherwise(0)), F.lit(0))


SITE_GEO = ("site_id", "site_name", "city", "state", "latitude", "longitude", "is_hq", "parking_capacity")
SITE_COORDS = ("site_id", "latitude", "longitude", "is_hq", "parking_capacity")


def site_geo(dim_site: DataFrame, coords_only: bool = False) -> DataFrame:
    """Site attributes used on maps; ``coords_only`` leaves out names the fact already has."""
    return dim_site.select(*(SITE_COORDS if coords_only else SITE_GEO))


def enrich_geo(aggregate: DataFrame, geo: DataFrame, key: str) -> DataFrame:
    """Attach site attributes to rows already reduced to site grain."""
    return aggregate.join(geo.withColumnRenamed("site_id", key), key, "left")

