"""Write a synthetic fleet to files, check it, and say what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motorpool.operators import quality
from motorpool.operators.cleaning import cast_columns
from motorpool.schemas import ENTITIES, Entity
from motorpool.sources import tables
from motorpool.synth import fleet


def read_raw(spark: SparkSession, directory: str, entity: Entity, fmt: str = "parquet") -> DataFrame:
    """One landed entity in its raw form, whichever tool wrote the files.

    Columns with gaps may have been written as floating-point numbers; they come back as the
    declared whole numbers. Dates and timestamps stay text.
    """
    if fmt == "csv":
        text = T.StructType([T.StructField(c, T.StringType()) for c in entity.columns])
        df = tables.read_entity(spark, directory, entity.name, text, "csv")
    else:
        df = spark.read.parquet(f"{directory}/{entity.name}.parquet")
    typed = {c: t for c, t in entity.types.items() if t not in ("string", "date", "timestamp")}
    return cast_columns(df, typed).select(*entity.columns)


def read_fleet(spark: SparkSession, directory: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """The nine landed entities."""
    return {name: read_raw(spark, directory, entity, fmt) for name, entity in ENTITIES.items()}


def write_fleet(spark: SparkSession, size: fleet.Size, directory: str, fmt: str = "both") -> DataFrame:
    """Write all entities and a manifest; stop if a reference does not resolve.

    Checks and counts read the files back, so no table is made twice.
    """
    for name, df in fleet.entities(spark, size).items():
        tables.write_entity(df, directory, name, fmt)
    written = read_fleet(spark, directory, "csv" if fmt == "csv" else "parquet")
    quality.require_fks(written, quality.entity_relations(written))
    one_way = written["rentals"].agg(F.count_if("is_one_way")).first()[0]
    if not one_way:
        raise quality.QualityError("no one-way rental")
    facts = {
        "seed": F.lit(size.seed),
        "history_start": F.lit(size.start.date().isoformat()),
        "history_end": F.lit(size.end.date().isoformat()),
        "one_way_rentals": F.lit(one_way),
    }
    listed = tables.manifest(written).withColumns(facts)
    listed.coalesce(1).write.mode("overwrite").json(f"{directory}/manifest")
    return spark.read.schema(listed.schema).json(f"{directory}/manifest")
