"""Alert rules. One condition per rule; the same code runs on a table and on a stream."""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorpool.functions.text import not_empty
from motorpool.operators.rollups import IDLE_LIMIT_MINUTES

# Fixed value: a vehicle beyond this reading is due for service.
SERVICE_DUE_MILES = 75000

OPERATORS: dict[str, Callable[[Column, object], Column]] = {
    "GreaterThan": operator.gt,
    "GreaterThanOrEqual": operator.ge,
    "LessThan": operator.lt,
    "LessThanOrEqual": operator.le,
    "Equal": operator.eq,
    "IsNotEmpty": lambda column, _: not_empty(column),
}


@dataclass(frozen=True)
class Rule:
    """``attribute`` of an object, compared with ``threshold``; ``action`` says what follows.

    ``headline`` is what a notified person reads.
    """

    name: str
    attribute: str
    operator: str
    threshold: object = None
    action: str = "notify"
    headline: str = ""

    def condition(self) -> Column:
        return F.coalesce(OPERATORS[self.operator](F.col(self.attribute), self.threshold), F.lit(False))


# The rules the fleet is watched with.
IDLE = Rule(
    "IdleVehicleAlert",
    "idle_minutes",
    "GreaterThan",
    IDLE_LIMIT_MINUTES,
    headline="Vehicle idle for too long: consider moving it",
)
FAULT = Rule(
    "MaintenanceFaultAlert",
    "fault_code",
    "IsNotEmpty",
    headline="Vehicle reports a fault: schedule maintenance before its next rental",
)
OVERDUE = Rule(
    "MaintenanceOverdueAlert",
    "odometer_miles",
    "GreaterThan",
    SERVICE_DUE_MILES,
    headline="Vehicle is due for service",
)
WORK_ORDER = Rule("WorkOrderOnFault", "fault_code", "IsNotEmpty", action="work_order")
FLEET_RULES = (IDLE, FAULT, OVERDUE, WORK_ORDER)


def idle_alerts(events: DataFrame, threshold: int = IDLE_LIMIT_MINUTES) -> DataFrame:
    """Readings idle for longer than the threshold; exactly the threshold is no alert."""
    columns = ["vehicle_id", "site_id", "ts", "idle_minutes", "ignition_state", "latitude", "longitude"]
    return _project(events.filter(F.col("idle_minutes") > threshold), columns)


def fault_alerts(events: DataFrame) -> DataFrame:
    """Readings with a diagnostic trouble code."""
    return _project(events.filter(not_empty("fault_code")), ["vehicle_id", "site_id", "ts", "fault_code", "odometer_miles"])


def overdue_alerts(events: DataFrame, limit: int = SERVICE_DUE_MILES) -> DataFrame:
    """Readings beyond the service mileage."""
    return _project(events.filter(F.col("odometer_miles") > limit), ["vehicle_id", "site_id", "ts", "odometer_miles"])


def _project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    arrival = [c for c in ("ingested_at",) if c in df.columns]
    return df.select(*columns, *arrival)


def evaluate_rules(events: DataFrame, rules: Sequence[Rule] = FLEET_RULES, key: str = "vehicle_id") -> DataFrame:
    """One row per event and rule it breaks, with the value that broke it.

    All rules are tried in one pass over the events.
    """
    hits = F.array(
        *[
            F.when(
                r.condition(),
                F.struct(
                    F.lit(r.name).alias("rule"),
                    F.lit(r.action).alias("action"),
                    F.lit(r.attribute).alias("attribute"),
                    F.col(r.attribute).cast("string").alias("value"),
                ),
            )
            for r in rules
        ]
    )
    matched = events.withColumn("_hit", F.explode(F.array_compact(hits)))
    return matched.select(
        "_hit.rule",
        "_hit.action",
        F.col(key).alias("object_key"),
        "event_id",
        "site_id",
        "ts",
        "_hit.attribute",
        "_hit.value",
    )


def work_orders(alerts: DataFrame) -> DataFrame:
    """Work-order rows for alerts that ask for one: where, which vehicle and why."""
    return alerts.filter(F.col("action") == "work_order").select(
        F.concat_ws(":", "rule", F.col("event_id").cast("string")).alias("work_order_id"),
        "site_id",
        F.col("object_key").alias("vehicle_id"),
        F.col("value").alias("reason"),
        F.col("ts").alias("opened_ts"),
    )


def notifications(
    alerts: DataFrame, recipients: DataFrame, default: str, rules: Sequence[Rule] = FLEET_RULES
) -> DataFrame:
    """Messages for alerts that notify: to whom, what about and on which grounds.

    ``recipients`` maps ``site_id`` to ``recipient``; other sites go to ``default``. Sending
    them is somebody else's job.
    """
    headline = F.lit(None).cast("string")
    for r in rules:
        headline = F.when(F.col("rule") == r.name, r.headline).otherwise(headline)
    routed = alerts.filter(F.col("action") == "notify").join(
        recipients.select("site_id", "recipient"), "site_id", "left"
    )
    return routed.select(
        F.coalesce("recipient", F.lit(default)).alias("sent_to"),
        headline.alias("headline"),
        F.concat_ws(" ", F.col("attribute"), F.lit("="), F.col("value")).alias("reason"),
        F.col("object_key").alias("vehicle_id"),
        "site_id",
        "ts",
        "rule",
        "event_id",
    )
