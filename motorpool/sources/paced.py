"""A stored event feed replayed at a rate: so many events a second, in the order of time.

Events are numbered once and stored in files that hold one stretch of numbers each. A stream of ticks, one for every
event that has become due, says which numbers to pass on; its offsets are kept in the checkpoint, so a restart goes on
with the next event, and a batch that runs again passes on the same ones.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

NUMBER = "event_number"


def number_events(events: DataFrame, path: str, order: Sequence[str] = ("ts", "event_id"), files: int = 8) -> DataFrame:
    """Store the events with their number from 0 in the given order, in files of consecutive numbers.

    Ranges of the order are sorted each in a task of its own; only their sizes meet. Rows equal in all of ``order`` are
    numbered in any order, once.
    """
    spark = events.sparkSession
    ranged = events.repartitionByRange(files, *order).sortWithinPartitions(*order)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    # Stored before they are numbered: range borders are sampled and may not be the same twice.
    ranged.withColumns({"_part": F.spark_partition_id(), "_place": inside}).write.parquet(f"{path}/ranges")
    stored = spark.read.parquet(f"{path}/ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stored.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    # One row per range, never more than there are files: the limit cuts nothing, but Spark plans the join by it.
    numbered = stored.join(sizes.drop("count").limit(files), "_part").withColumn(NUMBER, F.col("_before") + F.col("_place"))
    numbered.drop("_part", "_place", "_before").write.parquet(f"{path}/numbered")
    return spark.read.parquet(f"{path}/numbered")


def paced(
    spark: SparkSession,
    numbered: DataFrame,
    per_second: int,
    deliver: Callable[[DataFrame, int], None],
    checkpoint: str,
    interval: str = "1 second",
) -> StreamingQuery:
    """Pass on ``per_second`` events for each second since the checkpoint was made, until the query is stopped.

    ``deliver`` gets the events that have become due, without their number, and the number of the micro-batch; it is
    called again for a batch that failed, and not for one without events. What became due while the query was down
    comes with the first batch after it.
    """
    events = numbered.columns

    def batch(ticks: DataFrame, batch_id: int) -> None:
        due = ticks.agg(F.min("value").alias("low"), F.max("value").alias("high")).first()
        if due.low is None:
            return
        # A range on the number: other files are not opened.
        rows = numbered.where(F.col(NUMBER).between(due.low, due.high))
        if not rows.isEmpty():
            deliver(rows.select(*[c for c in events if c != NUMBER]), batch_id)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    writer = ticks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=interval).start()
