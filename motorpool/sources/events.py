"""The telematics event feed: reading, mapping, landing."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from motorpool.functions import calendar, text
from motorpool.schemas import EVENT

JsonMapping = Mapping[str, tuple[str, str]]

# Every event property sits at the top level of the JSON object.
EVENT_MAPPING: JsonMapping = {c: (f"$.{c}", t) for c, t in EVENT.types.items()}


def apply_json_mapping(df: DataFrame, column: str, mapping: JsonMapping, keep: Sequence[str] = ()) -> DataFrame:
    """Bind JSON paths in a text column to typed columns; what does not parse becomes null."""

    def bound(path: str, dtype: str) -> Column:
        if dtype == "timestamp":
            return calendar.parse_iso(text.json_value(column, path))
        return text.json_value(column, path, dtype)

    return df.select(*keep, *[bound(p, t).alias(c) for c, (p, t) in mapping.items()])


def read_events(spark: SparkSession, directory: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream newline-delimited JSON events from a directory to which files are added."""
    reader = spark.readStream.schema(EVENT.schema()).option("timestampFormat", calendar.ISO_UTC)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(directory)


def replay(spark: SparkSession, directory: str, max_files_per_trigger: int = 1) -> DataFrame:
    """The same feed, paced: at most so many files per micro-batch."""
    return read_events(spark, directory, max_files_per_trigger)


def stream_table(spark: SparkSession, path: str, schema: object, fmt: str = "parquet") -> DataFrame:
    """Stream the files of an append-only table."""
    return spark.readStream.schema(schema).format(fmt).load(path)


def with_ingestion_time(events: DataFrame) -> DataFrame:
    return events.withColumn("ingested_at", F.current_timestamp())


@dataclass(frozen=True)
class Output:
    """Where a stream goes: files at ``path`` holding ``select`` of each micro-batch."""

    path: str
    select: Callable[[DataFrame], DataFrame] = lambda batch: batch
    partition_by: tuple[str, ...] = ()
    fmt: str = "parquet"


def append_outputs(
    stream: DataFrame, checkpoint: str, outputs: Sequence[Output], mode: str = "append"
) -> StreamingQuery:
    """Append a stream to one or more outputs, reading it once, then stop when caught up.

    Each micro-batch goes to a directory named after the query and the batch. A batch that runs
    again after a failure overwrites its own directory, so rows are stored once. A new
    checkpoint is a new query: it adds its rows and does not touch what earlier queries wrote.
    (Spark's file sink would skip the batches of a new checkpoint over an old path.)
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]
        if len(outputs) > 1:
            batch.persist()
        try:
            for output in outputs:
                writer = output.select(batch).write.format(output.fmt).mode("overwrite")
                if output.partition_by:
                    writer = writer.partitionBy(*output.partition_by)
                writer.save(f"{output.path}/flow={query}/batch={batch_id}")
        finally:
            batch.unpersist()

    writer = stream.writeStream.outputMode(mode).foreachBatch(store)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_flow(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    projection: Sequence[str | Column] = ("*",),
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
) -> StreamingQuery:
    """Append the chosen columns of a stream to files at ``path``; see :func:`append_outputs`."""
    output = Output(path, partition_by=tuple(partition_by), fmt=fmt)
    return append_outputs(stream.select(*projection), checkpoint, [output])


def read_flow(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """What :func:`append_flow` has stored so far."""
    return spark.read.format(fmt).load(path).drop("flow", "batch")


def upsert_flow(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Store every row of an aggregate each time it changes; :func:`read_latest` shows the last state of each.

    Groups that a watermark has not closed yet are stored as they stand, so nothing waits for later events.
    """
    return append_outputs(stream, checkpoint, [Output(path)], mode="update")


def read_latest(spark: SparkSession, path: str, key: str, fmt: str = "parquet") -> DataFrame:
    """The last stored row of each key of one :func:`upsert_flow` query."""
    stored = spark.read.format(fmt).load(path)
    columns = [c for c in stored.columns if c not in ("flow", "batch")]
    last = stored.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*columns), "batch").alias("_row"))
    return last.select("_row.*")


def dropped_late(query: StreamingQuery) -> int:
    """Events a finished query left out because they came later than its watermark allows."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def landed(events: DataFrame) -> DataFrame:
    """Events with their ingestion time and their day, which the event table is laid out by."""
    return with_ingestion_time(events).withColumn("event_date", F.to_date("ts"))


def land_events(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append events with their ingestion time, in one directory per event day."""
    return append_flow(landed(stream), path, checkpoint, partition_by=("event_date",))
