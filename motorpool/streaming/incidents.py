"""Elevated readings of a vehicle that follow one another, as incidents with a begin, an end and a peak."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorpool.functions.text import not_empty

# Fixed value: readings above this many idle minutes are alerts.
IDLE_LIMIT_MINUTES = 120


def elevated(idle_limit: int = IDLE_LIMIT_MINUTES) -> Column:
    return F.coalesce(F.col("idle_minutes") > idle_limit, F.lit(False)) | F.coalesce(not_empty("fault_code"), F.lit(False))


def incidents(events: DataFrame, gap_minutes: int = 60, idle_limit: int = IDLE_LIMIT_MINUTES, ts: str = "ts") -> DataFrame:
    """One row per incident: elevated readings of one vehicle, each less than ``gap_minutes`` after the one before.

    Readings that share a stretch of that length on the clock are always one incident, so they are added up first,
    where they are read; only these sums are put in order per vehicle. Readings without a vehicle form incidents of
    their own, like those of any vehicle; readings without a time belong to none.
    """
    gap = gap_minutes * 60_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    sums = (
        events.where(elevated(idle_limit) & F.col(ts).isNotNull())
        .groupBy("vehicle_id", F.floor(at / gap).alias("_stretch"))
        .agg(
            F.min(ts).alias("begin_ts"),
            F.max(ts).alias("end_ts"),
            F.count(F.lit(1)).alias("readings"),
            F.max("idle_minutes").alias("peak_idle_minutes"),
            F.count_if(not_empty("fault_code")).alias("faults"),
            F.min(at).alias("_from"),
            F.max(at).alias("_to"),
        )
    )
    in_order = Window.partitionBy("vehicle_id").orderBy("_stretch")
    begins = F.coalesce(F.col("_from") - F.lag("_to").over(in_order) >= gap, F.lit(True))
    numbered = sums.withColumn("_begins", begins).withColumn("_number", F.count_if("_begins").over(in_order))
    return (
        numbered.groupBy("vehicle_id", "_number")
        .agg(
            F.min("begin_ts").alias("begin_ts"),
            F.max("end_ts").alias("end_ts"),
            F.sum("readings").alias("readings"),
            F.max("peak_idle_minutes").alias("peak_idle_minutes"),
            F.sum("faults").alias("faults"),
        )
        .drop("_number")
    )


def stream_incidents(
    events: DataFrame, gap_minutes: int = 60, delay: str = "10 minutes", idle_limit: int = IDLE_LIMIT_MINUTES, ts: str = "ts"
) -> DataFrame:
    """The same on a stream: an incident is passed on once no reading can prolong it any more.

    That is when the newest event is ``gap_minutes`` and ``delay`` past its last reading. Events that come later than
    ``delay`` behind the newest one are left out.
    """
    session = F.session_window(ts, f"{gap_minutes} minutes")
    # All events move the watermark on, so the filter has to stay behind it; one that reads the time does.
    chosen = F.when(F.col(ts).isNotNull(), elevated(idle_limit)).otherwise(F.lit(False))
    found = events.withWatermark(ts, delay).where(chosen).groupBy("vehicle_id", session.alias("_session"))
    return found.agg(
        F.min(ts).alias("begin_ts"),
        F.max(ts).alias("end_ts"),
        F.count(F.lit(1)).alias("readings"),
        F.max("idle_minutes").alias("peak_idle_minutes"),
        F.count_if(not_empty("fault_code")).alias("faults"),
    ).drop("_session")
