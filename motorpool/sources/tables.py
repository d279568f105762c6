"""Tables in the catalog, tables at a path, and entity files."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import date, timedelta
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_FORMAT = "parquet"

# A text no field holds, so that no written value is taken for null.
NO_TEXT = "\u0000"


def qualified(*parts: str) -> str:
    """Dotted table name; empty parts are left out."""
    return ".".join(p for p in parts if p)


def read_table(spark: SparkSession, *parts: str) -> DataFrame:
    return spark.table(qualified(*parts))


def read_external(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, fmt: str = DEFAULT_FORMAT
) -> DataFrame:
    """Files at a path that somebody else owns, read as a table."""
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def register_external(
    spark: SparkSession,
    name: str,
    path: str,
    schema: T.StructType | None = None,
    fmt: str = DEFAULT_FORMAT,
) -> DataFrame:
    """Create a catalog entry over files at ``path``; dropping it leaves the files alone."""
    return spark.catalog.createTable(name, path=path, source=fmt, schema=schema)


def table_location(spark: SparkSession, name: str) -> str:
    """Storage path of a table."""
    detail = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter("col_name = 'Location'")
    return detail.first()["data_type"]


def write_entity(df: DataFrame, directory: str, name: str, fmt: str = "both") -> list[str]:
    """Write an entity as CSV, Parquet or both, one directory per format."""
    paths = []
    for one in ("csv", "parquet") if fmt == "both" else (fmt,):
        path = f"{directory}/{name}.{one}"
        writer = df.write.mode("overwrite")
        if one == "csv":
            writer.option("header", True).csv(path)
        else:
            writer.parquet(path)
        paths.append(path)
    return paths


def read_entity(spark: SparkSession, directory: str, name: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Read back what :func:`write_entity` wrote; the schema is given, never inferred.

    In CSV an empty field is null and a quoted empty field is the empty text.
    """
    reader = spark.read.schema(schema)
    path = f"{directory}/{name}.{fmt}"
    if fmt != "csv":
        return reader.parquet(path)
    return reader.option("header", True).option("nullValue", NO_TEXT).csv(path)


def overwrite_table(
    df: DataFrame, name: str, fmt: str = DEFAULT_FORMAT, bucket_by: tuple[int, str] | None = None
) -> DataFrame:
    """Replace a managed table, schema included, and hand back the stored table.

    ``bucket_by`` (number, column) lets later joins on the column read the table where it lies,
    given at least as many buckets as ``spark.sql.shuffle.partitions``. Use it for unique columns
    only: a value that repeats much would fill one bucket.
    """
    if bucket_by:
        number, column = bucket_by
        # One task per bucket, hence one file per bucket.
        df = df.repartition(number, column)
    writer = df.write.format(fmt).mode("overwrite").option("overwriteSchema", "true")
    if bucket_by:
        writer = writer.bucketBy(number, column).sortBy(column)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def write_optimized(
    df: DataFrame,
    name: str,
    sort_cols: Sequence[str] = (),
    cluster_by: Sequence[str] = (),
    target_rows: int = 0,
    fmt: str = DEFAULT_FORMAT,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """Replace a table with few, evenly filled, sorted files.

    The rebalance hint lets adaptive execution merge small partitions and cut large ones to the
    advised size (``spark.sql.adaptive.advisoryPartitionSizeInBytes``), skewed keys included.
    ``target_rows`` bounds the rows per file.
    """
    laid_out = df.hint("rebalance", *cluster_by)
    if sort_cols:
        laid_out = laid_out.sortWithinPartitions(*sort_cols)
    writer = laid_out.write.format(fmt).mode("overwrite").option("overwriteSchema", "true")
    if target_rows:
        writer = writer.option("maxRecordsPerFile", target_rows)
    writer.saveAsTable(name)
    spark = df.sparkSession
    if properties:
        pairs = ", ".join(f"'{k}' = '{v}'" for k, v in properties.items())
        spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ({pairs})")
    return spark.table(name)


def write_by_day(df: DataFrame, path: str, ts: str, fmt: str = DEFAULT_FORMAT) -> None:
    """Append rows under one directory per event day; rows of a day that come later join it.

    Retention then drops whole days, and time filters read only the days they name. Appending is
    not repeated by Spark when a task is; a caller that runs the whole write again stores the rows
    again (:func:`replace_days` does not).
    """
    _by_day(df, ts).write.format(fmt).mode("append").partitionBy("event_date").save(path)


def replace_days(df: DataFrame, path: str, ts: str, fmt: str = DEFAULT_FORMAT) -> None:
    """Write whole days: every day that ``df`` has rows of is replaced, other days stay."""
    writer = _by_day(df, ts).write.format(fmt).mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("event_date").save(path)


def _by_day(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn("event_date", F.to_date(ts)).hint("rebalance", "event_date")


def expire_days(
    spark: SparkSession, name: str, keep_days: int, as_of: date, column: str = "event_date"
) -> list[date]:
    """Drop the days of a table that are older than ``keep_days``; it may be partitioned by more than the day.

    Whole partitions go, so no row is read or written: only names of expired partitions come to
    the driver, and one statement drops them. Returns the days dropped.
    """
    parts = spark.sql(f"SHOW PARTITIONS {name}").withColumn(
        "day", F.try_to_date(F.regexp_extract("partition", f"(?:^|/){column}=([^/]*)", 1))
    )
    oldest = as_of - timedelta(days=keep_days)
    expired = parts.filter(F.col("day") < F.lit(oldest)).orderBy("day", "partition").collect()
    if expired:
        specs = (
            ", ".join("`{}` = '{}'".format(*map(unquote, level.split("=", 1))) for level in row.partition.split("/"))
            for row in expired
        )
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS " + ", ".join(f"PARTITION ({s})" for s in specs))
    return sorted({row.day for row in expired})


def add_missing_columns(spark: SparkSession, name: str, schema: T.StructType) -> list[str]:
    """Let an event table grow: columns it lacks are added, none is dropped or retyped.

    Creates the table when there is none. Returns the names of the added columns.
    """
    if not spark.catalog.tableExists(name):
        spark.createDataFrame([], schema).write.format(DEFAULT_FORMAT).saveAsTable(name)
        return list(schema.names)
    present = {f.name.lower(): f.dataType for f in spark.table(name).schema}
    retyped = [f.name for f in schema if present.get(f.name.lower(), f.dataType) != f.dataType]
    if retyped:
        raise ValueError(f"{name}: columns would change type: {', '.join(retyped)}")
    missing = [f for f in schema if f.name.lower() not in present]
    if missing:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in missing)
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({columns})")
    return [f.name for f in missing]


def describe_columns(spark: SparkSession, name: str, docs: Mapping[str, str]) -> None:
    """Attach a comment to each named column."""
    for column, text in docs.items():
        quoted = text.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"ALTER TABLE {name} ALTER COLUMN `{column}` COMMENT '{quoted}'")


def manifest(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: its name, row count and column list."""
    counts: Iterable[DataFrame] = (
        df.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("entity"), "rows", F.lit(",".join(df.columns)).alias("columns")
        )
        for name, df in tables.items()
    )
    first, *others = counts
    for other in others:
        first = first.unionByName(other)
    return first
