"""Certification registry and table lineage."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorpool.session import shared_dir

CERTIFIED = "CERTIFIED"


def certify(spark: SparkSession, tables: Sequence[str], by: str, date: str, layer: str = "gold") -> DataFrame:
    """The registry: one row per certified table."""
    rows = [(t, CERTIFIED, by, date, layer) for t in tables]
    columns = ["table_name", "certification_status", "certified_by", "certified_date", "data_layer"]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))


def tag_table(spark: SparkSession, name: str, by: str, date: str, layer: str = "gold", comment: str = "") -> None:
    """Put the same facts on the table itself as properties, and its comment."""
    tags = {
        "certification_status": CERTIFIED,
        "certified_by": by,
        "certified_date": date,
        "data_layer": layer,
    }
    pairs = ", ".join(f"'{k}' = '{v}'" for k, v in tags.items())
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ({pairs})")
    if comment:
        text = comment.replace("'", "\\'")
        spark.sql(f"COMMENT ON TABLE {name} IS '{text}'")


def table_tags(spark: SparkSession, name: str) -> DataFrame:
    """The certification properties of a table, one row each."""
    return spark.sql(f"SHOW TBLPROPERTIES {name}").filter(
        F.col("key").isin("certification_status", "certified_by", "certified_date", "data_layer")
    )


def lineage(spark: SparkSession, pipeline: Mapping[str, Iterable[str]]) -> DataFrame:
    """Direct edges ``src -> dst`` of a pipeline given as table -> its inputs."""
    rows = [(src, dst) for dst, inputs in pipeline.items() for src in inputs]
    return spark.createDataFrame(rows, "src string, dst string")


def upstream(edges: DataFrame) -> DataFrame:
    """All pairs ``src -> dst`` connected by a path of any length.

    Each round joins the pairs found so far with themselves, so path lengths double and the
    number of rounds grows with the logarithm of the depth. Rounds are cut with a reliable
    checkpoint, which keeps the plan short and survives lost executors.
    """
    shared_dir(edges.sparkSession)
    reached = edges.select("src", "dst").distinct().checkpoint()
    known = reached.count()
    while True:
        onward = reached.select(F.col("src").alias("dst"), F.col("dst").alias("_next"))
        longer = reached.join(onward, "dst").select("src", F.col("_next").alias("dst"))
        grown = reached.union(longer).distinct().checkpoint()
        total = grown.count()
        if total == known:
            return grown
        reached, known = grown, total
