"""The nine batch entities and the telematics event: columns, keys, references and rules.

Everything that checks or cleans an entity (casts, text folding, key and reference checks,
contracts) is driven from these declarations.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class Entity:
    """One table.

    ``columns`` maps a column to its Spark type; a trailing ``!`` marks it as required.
    ``refs`` maps a column to the entity whose key it must resolve to.
    """

    name: str
    key: str
    columns: Mapping[str, str]
    refs: Mapping[str, str] = field(default_factory=dict)
    text: Mapping[str, str] = field(default_factory=dict)
    enums: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    pii: tuple[str, ...] = ()

    @property
    def types(self) -> dict[str, str]:
        return {c: t.rstrip("!") for c, t in self.columns.items()}

    @property
    def required(self) -> list[str]:
        return [c for c, t in self.columns.items() if t.endswith("!")]

    def schema(self) -> T.StructType:
        """Typed schema, as the cleaned tables have it."""
        return self._struct(self.types)

    def raw_schema(self) -> T.StructType:
        """Schema of the landed files: dates and timestamps are still ISO text."""
        return self._struct({c: "string" if t in ("date", "timestamp") else t for c, t in self.types.items()})

    @staticmethod
    def _struct(types: Mapping[str, str]) -> T.StructType:
        return T.StructType([T.StructField(c, _TYPES[t], True) for c, t in types.items()])


_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "double": T.DoubleType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
}

# Column names, types, keys, references and enumerations of the entities.

VEHICLE_CLASSES = Entity(
    "vehicle_classes",
    "vehicle_class_id",
    {
        "vehicle_class_id": "string!",
        "class_name": "string!",
        "category": "string!",
        "daily_base_rate_usd": "double!",
        "seats": "int!",
        "is_ev": "boolean!",
    },
    enums={"category": ("Car", "SUV", "Luxury", "Van", "Truck", "EV")},
)

SITES = Entity(
    "sites",
    "site_id",
    {
        "site_id": "string!",
        "site_code": "string!",
        "site_name": "string!",
        "city": "string!",
        "state": "string!",
        "latitude": "double!",
        "longitude": "double!",
        "is_hq": "boolean!",
        "parking_capacity": "int!",
        "opened_date": "date!",
    },
    text={"city": "trim", "state": "upper"},
)

VEHICLES = Entity(
    "vehicles",
    "vehicle_id",
    {
        "vehicle_id": "string!",
        "vin": "string!",
        "vehicle_class_id": "string!",
        "make": "string!",
        "model": "string!",
        "model_year": "int!",
        "color": "string!",
        "license_plate": "string!",
        "home_site_id": "string!",
        "current_site_id": "string!",
        "status": "string!",
        "odometer_miles": "long!",
        "acquired_date": "date!",
    },
    refs={"vehicle_class_id": "vehicle_classes", "home_site_id": "sites", "current_site_id": "sites"},
    text={"status": "lower"},
    enums={"status": ("available", "rented", "idle", "maintenance")},
)

CUSTOMERS = Entity(
    "customers",
    "customer_id",
    {
        "customer_id": "string!",
        "first_name": "string!",
        "last_name": "string!",
        "email": "string!",
        "phone": "string!",
        "loyalty_tier": "string!",
        "home_city": "string!",
        "home_state": "string!",
        "join_date": "date!",
    },
    text={"email": "trim", "phone": "trim"},
    enums={"loyalty_tier": ("None", "Silver", "Gold", "Platinum")},
    pii=("email", "phone"),
)

RESERVATIONS = Entity(
    "reservations",
    "reservation_id",
    {
        "reservation_id": "string!",
        "customer_id": "string!",
        "vehicle_class_id": "string!",
        "pickup_site_id": "string!",
        "return_site_id": "string!",
        "reserved_at": "timestamp!",
        "pickup_date": "date!",
        "planned_return_date": "date!",
        "status": "string!",
    },
    refs={
        "customer_id": "customers",
        "vehicle_class_id": "vehicle_classes",
        "pickup_site_id": "sites",
        "return_site_id": "sites",
    },
    text={"status": "lower"},
    enums={"status": ("booked", "fulfilled", "cancelled", "noshow")},
)

RENTALS = Entity(
    "rentals",
    "rental_id",
    {
        "rental_id": "string!",
        "reservation_id": "string",
        "customer_id": "string!",
        "vehicle_id": "string!",
        "vehicle_class_id": "string!",
        "pickup_site_id": "string!",
        "return_site_id": "string!",
        "pickup_ts": "timestamp!",
        "planned_return_ts": "timestamp!",
        "return_ts": "timestamp",
        "odometer_out": "long!",
        "odometer_in": "long",
        "miles_driven": "long",
        "is_one_way": "boolean!",
        "status": "string!",
    },
    refs={
        "reservation_id": "reservations",
        "customer_id": "customers",
        "vehicle_id": "vehicles",
        "vehicle_class_id": "vehicle_classes",
        "pickup_site_id": "sites",
        "return_site_id": "sites",
    },
    text={"status": "lower"},
    enums={"status": ("open", "closed")},
)

PAYMENTS = Entity(
    "payments",
    "payment_id",
    {
        "payment_id": "string!",
        "rental_id": "string!",
        "customer_id": "string!",
        "pickup_site_id": "string!",
        "rental_days": "int!",
        "base_amount_usd": "double!",
        "one_way_fee_usd": "double!",
        "taxes_fees_usd": "double!",
        "total_amount_usd": "double!",
        "currency": "string!",
        "payment_method": "string!",
        "payment_ts": "timestamp!",
        "status": "string!",
    },
    refs={"rental_id": "rentals", "customer_id": "customers", "pickup_site_id": "sites"},
    text={"status": "lower"},
    enums={"currency": ("USD",), "status": ("captured", "refunded", "failed")},
)

MAINTENANCE = Entity(
    "maintenance",
    "maintenance_id",
    {
        "maintenance_id": "string!",
        "vehicle_id": "string!",
        "site_id": "string!",
        "maintenance_type": "string!",
        "fault_code": "string",
        "opened_ts": "timestamp!",
        "closed_ts": "timestamp",
        "labor_cost_usd": "double!",
        "parts_cost_usd": "double!",
        "total_cost_usd": "double!",
        "odometer_at_service": "long!",
        "status": "string!",
    },
    refs={"vehicle_id": "vehicles", "site_id": "sites"},
    text={"status": "lower"},
    enums={"status": ("open", "closed")},
)

TELEMATICS = Entity(
    "telematics",
    "telematics_id",
    {
        "telematics_id": "string!",
        "vehicle_id": "string!",
        "site_id": "string!",
        "snapshot_ts": "timestamp!",
        "ignition_state": "string!",
        "idle_minutes": "int!",
        "odometer_miles": "long!",
        "fault_code": "string",
        "latitude": "double!",
        "longitude": "double!",
        "speed_mph": "int!",
        "fuel_or_soc_pct": "int!",
    },
    refs={"vehicle_id": "vehicles", "site_id": "sites"},
    enums={"ignition_state": ("on", "off")},
)

EVENT = Entity(
    "telematics_event",
    "event_id",
    {
        "event_id": "string!",
        "vehicle_id": "string!",
        "site_id": "string!",
        "ts": "timestamp!",
        "ignition_state": "string!",
        "idle_minutes": "int!",
        "odometer_miles": "long!",
        "fault_code": "string",
        "latitude": "double!",
        "longitude": "double!",
        "speed_mph": "int!",
        "fuel_or_soc_pct": "int!",
        "is_spike": "boolean!",
    },
    refs={"vehicle_id": "vehicles", "site_id": "sites"},
    enums={"ignition_state": ("on", "off")},
)

ENTITIES: dict[str, Entity] = {
    e.name: e
    for e in (
        VEHICLE_CLASSES,
        SITES,
        VEHICLES,
        CUSTOMERS,
        RESERVATIONS,
        RENTALS,
        PAYMENTS,
        MAINTENANCE,
        TELEMATICS,
    )
}

# The ten references the cleaned layer must satisfy before gold is built.
SILVER_REFERENCES: tuple[tuple[str, str, str], ...] = (
    ("vehicles", "vehicle_class_id", "vehicle_classes"),
    ("vehicles", "home_site_id", "sites"),
    ("vehicles", "current_site_id", "sites"),
    ("rentals", "vehicle_id", "vehicles"),
    ("rentals", "customer_id", "customers"),
    ("rentals", "pickup_site_id", "sites"),
    ("rentals", "return_site_id", "sites"),
    ("payments", "rental_id", "rentals"),
    ("maintenance", "vehicle_id", "vehicles"),
    ("telematics", "vehicle_id", "vehicles"),
)
