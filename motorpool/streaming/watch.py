"""The live side as one job: events in, an event table and alerts out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from motorpool.operators.cleaning import dedup
from motorpool.sources.events import Output, append_outputs, landed, read_events, read_flow
from motorpool.streaming.jobs import dedup_events
from motorpool.streaming.rules import FLEET_RULES, Rule, evaluate_rules, work_orders


@dataclass(frozen=True)
class Watched:
    """What a watch has stored so far."""

    events: DataFrame
    raised: DataFrame

    @property
    def alerts(self) -> DataFrame:
        """One row per rule and event, however often the event was delivered."""
        return dedup(self.raised, ["rule", "event_id"])

    @property
    def work_orders(self) -> DataFrame:
        return work_orders(self.alerts)


def watch(
    spark: SparkSession,
    events_dir: str,
    out: str,
    checkpoint: str,
    delay: str | None = None,
    rules: Sequence[Rule] = FLEET_RULES,
) -> Watched:
    """Catch up with the feed: land new events and raise their alerts, reading them once.

    Run again to continue where the checkpoint stands. Without ``delay`` every event is kept,
    however late, as often as it was delivered. With ``delay`` copies are dropped on the way in,
    and so are events that arrive later than that.
    """
    stream = read_events(spark, events_dir)
    if delay is not None:
        stream = dedup_events(stream, delay)
    outputs = [
        Output(f"{out}/events", partition_by=("event_date",)),
        Output(f"{out}/alerts", lambda batch: evaluate_rules(batch, rules)),
    ]
    append_outputs(landed(stream), checkpoint, outputs).awaitTermination()
    return Watched(read_flow(spark, f"{out}/events"), read_flow(spark, f"{out}/alerts"))
