"""Stream transformations and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from motorpool.functions.text import not_empty
from motorpool.sources.events import append_flow

CURATED = (
    "telematics_id",
    "vehicle_id",
    "snapshot_ts",
    "latitude",
    "longitude",
    "speed_mph",
    "odometer_miles",
    "idle_minutes",
    "fuel_or_soc_pct",
)


def telematics_curated(stream: DataFrame) -> DataFrame:
    return stream.select(*CURATED)


def dedup_events(stream: DataFrame, delay: str, ts: str = "ts") -> DataFrame:
    """Each event once, as long as its copies arrive within ``delay`` of each other.

    The watermark lets Spark forget event ids, so state stays bounded by the event rate. Events
    that arrive later than ``delay`` behind the newest one are dropped; ``dropped_late`` counts them.
    """
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["event_id"])


def spike_windows(
    events: DataFrame,
    width: str = "10 minutes",
    min_avg_idle: float | None = None,
    delay: str | None = None,
    ts: str = "ts",
) -> DataFrame:
    """Mean idle time and faults per time bucket, optionally only the elevated buckets.

    On a stream give ``delay``: buckets are then final once the watermark has passed them. Store
    them with ``upsert_flow``, which keeps the buckets that are still open too; how many events
    came too late for theirs tells ``dropped_late``.
    """
    if delay is not None:
        events = events.withWatermark(ts, delay)
    buckets = events.groupBy(F.window(ts, width).alias("w")).agg(
        F.count("*").alias("events"),
        F.avg("idle_minutes").alias("avg_idle"),
        F.count_if(not_empty("fault_code")).alias("faults"),
    )
    if min_avg_idle is not None:
        buckets = buckets.filter(F.col("avg_idle") >= min_avg_idle)
    return buckets.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "events", "avg_idle", "faults"
    )


def enrich_events(
    events: DataFrame,
    vehicles: DataFrame,
    sites: DataFrame,
    default_coord: tuple[float, float],
) -> DataFrame:
    """Place each event at its vehicle's current site, or the home site where that is unknown.

    Works on a stream with static ``vehicles`` and ``sites``. A site without coordinates gets
    ``default_coord``; ``vehicle_known`` tells whether the vehicle exists.
    """
    located = vehicles.select(
        "vehicle_id",
        F.coalesce("current_site_id", "home_site_id").alias("fleet_site_id"),
        F.lit(True).alias("_known"),
    )
    places = sites.select(
        F.col("site_id").alias("fleet_site_id"),
        F.col("latitude").alias("site_latitude"),
        F.col("longitude").alias("site_longitude"),
    )
    lat, lon = default_coord
    joined = events.join(located.join(places, "fleet_site_id", "left"), "vehicle_id", "left")
    return joined.withColumns(
        {
            "site_latitude": _or(F.col("site_latitude"), lat),
            "site_longitude": _or(F.col("site_longitude"), lon),
            "vehicle_known": F.col("_known").isNotNull(),
        }
    ).drop("_known")


def _or(column: Column, default: float) -> Column:
    return F.coalesce(column, F.lit(default))


def write_alerts(alerts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append alert rows as they are raised; read them back with ``read_flow``.

    A replayed micro-batch replaces its own rows, so an alert (rule and event) of one query is
    stored once. Feed the rules with :func:`dedup_events` where events may arrive repeatedly.
    """
    return append_flow(alerts, path, checkpoint)
