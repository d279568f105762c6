"""The fleet tables as views over the generic order tables the checks run on.

Each view is a projection or join of whole tables; nothing is sampled or cut.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorpool.lazy import LazyTables
from motorpool.operators.cleaning import rental_days

E = F.expr

# Fixed: columns of the order tables. With them no query has to open a file before it is planned.
BASE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz,"
        " o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double,"
        " l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}


class Fleet(LazyTables):
    """The fleet views of one data directory, by name."""

    def __init__(self, spark: SparkSession, directory: str) -> None:
        super().__init__({name: partial(view, self) for name, view in _VIEWS.items()})
        self.spark = spark
        self.directory = directory
        self._read: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        """One of the underlying tables, listed once."""
        if name not in self._read:
            read = self.spark.read.schema(BASE_SCHEMAS[name]) if name in BASE_SCHEMAS else self.spark.read
            self._read[name] = read.parquet(f"{self.directory}/{name}.parquet")
        return self._read[name]


def _sites(f: Fleet) -> DataFrame:
    nation, region = f.base("nation"), f.base("region")
    return nation.join(region, E("n_regionkey = r_regionkey")).select(
        E("n_nationkey as site_id"),
        E("concat('ST', n_nationkey) as site_code"),
        E("n_name as site_name"),
        # Several sites to a city and several cities to a state: the grains differ.
        E("concat(r_name, '-', n_nationkey % 3) as city"),
        E("r_name as state"),
        E("cast(n_nationkey * 7 - 90 as double) as latitude"),
        E("cast(n_nationkey * 14 - 180 as double) as longitude"),
        E("n_nationkey = 0 as is_hq"),
        E("40 + n_nationkey * 5 as parking_capacity"),
        E("date_add(date'2015-01-01', n_nationkey * 30) as opened_date"),
    )


def _vehicle_classes(f: Fleet) -> DataFrame:
    return (
        f.base("part")
        .groupBy(E("p_type as vehicle_class_id"))
        .agg(E("min(p_retailprice) as daily_base_rate_usd"))
        .select(
            "vehicle_class_id",
            E("vehicle_class_id as class_name"),
            E("case when vehicle_class_id in ('LARGE', 'PROMO') then 'SUV' else 'Car' end as category"),
            "daily_base_rate_usd",
            E("case when vehicle_class_id in ('LARGE', 'PROMO') then 7 else 5 end as seats"),
            E("vehicle_class_id = 'ECONOMY' as is_ev"),
        )
    )


def _vehicles(f: Fleet) -> DataFrame:
    return f.base("part").select(
        E("p_partkey as vehicle_id"),
        E("concat('VIN', p_partkey) as vin"),
        E("p_type as vehicle_class_id"),
        E("p_brand as make"),
        E("p_name as model"),
        E("cast(2019 + p_partkey % 6 as int) as model_year"),
        E("split_part(p_name, ' ', 1) as color"),
        E("concat('LP', p_partkey) as license_plate"),
        E("cast(p_partkey % 25 as int) as home_site_id"),
        E(
            "cast(case when p_size % 4 = 0 then (p_partkey + p_size) % 25 else p_partkey % 25 end as int)"
            " as current_site_id"
        ),
        E(
            "case p_size % 10 when 0 then 'idle' when 1 then 'maintenance' when 2 then 'rented'"
            " when 3 then 'rented' when 4 then 'rented' else 'available' end as status"
        ),
        E("(p_partkey * 37) % 90000 as odometer_miles"),
        E("date_add(date'2019-01-01', cast(p_partkey % 1800 as int)) as acquired_date"),
    )


def _customers(f: Fleet) -> DataFrame:
    home = f["sites"].select(E("site_id as c_nationkey"), E("city as home_city"), E("state as home_state"))
    return (
        f.base("customer")
        .join(home, "c_nationkey", "left")
        .select(
            E("c_custkey as customer_id"),
            E("split_part(c_name, '#', 1) as first_name"),
            E("split_part(c_name, '#', 2) as last_name"),
            E("concat(lower(c_name), '@example.com') as email"),
            E("concat('+1-555-', 100 + c_custkey % 900, '-', 1000 + c_custkey % 9000) as phone"),
            E("c_mktsegment as loyalty_tier"),
            "home_city",
            "home_state",
            E("date_add(date'2018-01-01', cast(c_custkey % 2400 as int)) as join_date"),
        )
    )


def _rentals(f: Fleet) -> DataFrame:
    handed_over = f.base("lineitem").groupBy(E("l_orderkey as o_orderkey")).agg(E("min(l_partkey) as vehicle_id"))
    pickup = f.base("customer").select(E("c_custkey as o_custkey"), E("c_nationkey as pickup_site_id"))
    closed = "o_orderstatus <> 'O'"
    out = "24 * (1 + o_orderkey % 13) + o_orderkey % 48 - 12"
    view = (
        f.base("orders")
        .join(pickup, "o_custkey")
        .join(handed_over, "o_orderkey", "left")
        .select(
            E("o_orderkey as rental_id"),
            E("case when o_orderkey % 11 <> 0 then o_orderkey end as reservation_id"),
            E("o_custkey as customer_id"),
            "vehicle_id",
            "pickup_site_id",
            E(
                "cast(case when o_orderkey % 100 < 18 then (pickup_site_id + 1 + o_orderkey % 24) % 25"
                " else pickup_site_id end as int) as return_site_id"
            ),
            E("o_orderdate as pickup_ts"),
            E("o_orderdate + make_dt_interval(cast(1 + o_orderkey % 13 as int)) as planned_return_ts"),
            E(f"case when {closed} then o_orderdate + make_dt_interval(0, cast({out} as int)) end as return_ts"),
            E("2000 + o_orderkey % 83000 as odometer_out"),
            E(f"case when {closed} then 40 + (o_orderkey * 31) % 1760 end as miles_driven"),
            E("o_orderkey % 100 < 18 as is_one_way"),
            E(f"case when {closed} then 'closed' else 'open' end as status"),
        )
    )
    return rental_days(view)


def _reservations(f: Fleet) -> DataFrame:
    classes = "array('ECONOMY', 'LARGE', 'PROMO', 'SMALL', 'STANDARD', 'MEDIUM')"
    return (
        f.base("orders")
        .filter("o_orderkey % 7 <> 0")
        .select(
            E("o_orderkey as reservation_id"),
            E("o_custkey as customer_id"),
            E(f"case when o_orderkey % 53 <> 0 then {classes}[cast(o_orderkey % 6 as int)] else 'NONE' end as vehicle_class_id"),
            E("cast(o_custkey % 25 as int) as pickup_site_id"),
            E("cast(o_orderkey % 25 as int) as return_site_id"),
            E("o_orderdate - make_dt_interval(cast(1 + o_orderkey % 40 as int)) as reserved_at"),
            E("cast(o_orderdate as date) as pickup_date"),
            E("date_add(cast(o_orderdate as date), cast(1 + o_orderkey % 13 as int)) as planned_return_date"),
            E(
                "case when o_orderkey % 19 = 0 then 'noshow' when o_orderkey % 17 = 0 then 'cancelled'"
                " when o_orderstatus = 'O' then 'booked' else 'fulfilled' end as status"
            ),
        )
    )


# Prices and rates of the line table in whole cents and percent: their products are exact.
CENTS = "floor(l_extendedprice * 100 + 0.5)"
DISCOUNT = "floor(l_discount * 100 + 0.5)"
TAX = "floor(l_tax * 100 + 0.5)"


def _payments(f: Fleet) -> DataFrame:
    paid = f.base("orders").filter("o_orderstatus <> 'O'").select(E("o_orderkey as l_orderkey"), "o_custkey")
    base, tax = f"{CENTS} * (100 - {DISCOUNT})", f"{CENTS} * {TAX}"
    fee = "case when l_orderkey % 100 < 18 then 75 else 0 end"
    return (
        f.base("lineitem")
        .join(paid, "l_orderkey")
        .select(
            E("concat(l_orderkey, '-', l_linenumber) as payment_id"),
            E("l_orderkey as rental_id"),
            E("o_custkey as customer_id"),
            E(f"({base}) / 10000D as base_amount_usd"),
            E(f"cast({fee} as double) as one_way_fee_usd"),
            E(f"({tax}) / 10000D as taxes_fees_usd"),
            E("'USD' as currency"),
            E("l_shipdate as payment_ts"),
            E("case when l_returnflag = 'R' then 'refunded' else 'captured' end as status"),
            E(f"({base} + {tax} + ({fee}) * 10000) / 10000D as total_amount_usd"),
        )
    )


def _maintenance(f: Fleet) -> DataFrame:
    shop = f.base("supplier").select(E("s_suppkey as l_suppkey"), E("s_nationkey as site_id"))
    return (
        f.base("lineitem")
        .filter("l_returnflag = 'R'")
        .join(shop, "l_suppkey")
        .select(
            E("concat(l_orderkey, '-', l_linenumber) as maintenance_id"),
            E("l_partkey as vehicle_id"),
            "site_id",
            E(f"{CENTS} * {DISCOUNT} / 10000D as labor_cost_usd"),
            E(f"{CENTS} * {TAX} / 10000D as parts_cost_usd"),
            E("l_shipdate as opened_ts"),
            E("case when l_linestatus = 'O' then 'open' else 'closed' end as status"),
            E(f"{CENTS} * ({DISCOUNT} + {TAX}) / 10000D as total_cost_usd"),
        )
    )


def event_columns(raw: DataFrame) -> DataFrame:
    """Telematics events from the generic event table; works on a stream as well."""
    return raw.select(
        "event_id",
        # Some devices do not say which vehicle they are in.
        E("case when event_id % 41 <> 0 then user_id % 200 end as vehicle_id"),
        E("cast(user_id % 25 as int) as site_id"),
        "ts",
        E("case when event_type in ('click', 'view') then 'on' else 'off' end as ignition_state"),
        E("cast(floor(value) as int) as idle_minutes"),
        E("(event_id * 97) % 100000 as odometer_miles"),
        E(
            "case event_type when 'error' then concat('P0', get_json_object(props, '$.k'))"
            " when 'signup' then '' end as fault_code"
        ),
        E("case when event_type = 'click' then cast(floor(value) as int) % 75 else 0 end as speed_mph"),
        E("cast(5 + event_id % 95 as int) as fuel_or_soc_pct"),
        E("user_id % 7 = 0 as is_spike"),
    )


def _events(f: Fleet) -> DataFrame:
    return event_columns(f.base("events"))


def _telematics(f: Fleet) -> DataFrame:
    return f["events"].withColumnsRenamed({"event_id": "telematics_id", "ts": "snapshot_ts"})


_VIEWS: dict[str, Callable[[Fleet], DataFrame]] = {
    "sites": _sites,
    "vehicle_classes": _vehicle_classes,
    "vehicles": _vehicles,
    "customers": _customers,
    "reservations": _reservations,
    "rentals": _rentals,
    "payments": _payments,
    "maintenance": _maintenance,
    "events": _events,
    "telematics": _telematics,
}
