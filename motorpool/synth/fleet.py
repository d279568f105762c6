"""The nine entities and the event feed, each as a lazy DataFrame of the size asked for.

Tables are in raw form: dates and timestamps are ISO text. Keys are numbered, so a reference
is a draw of a number and no table has to be collected or joined to make another. Vehicle
``i`` has class ``(i - 1) mod classes + 1``; the vehicles of a class are therefore known
without looking them up.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motorpool.functions import calendar
from motorpool.functions.money import price_columns
from motorpool.functions.text import formatted_key
from motorpool.operators.rollups import IDLE_LIMIT_MINUTES
from motorpool.schemas import ENTITIES, EVENT
from motorpool.synth import values as v
from motorpool.synth.draws import Draws


@dataclass(frozen=True)
class Size:
    """How much to make. ``end`` closes a history window of ``days`` days."""

    sites: int = 18
    vehicles: int = 600
    customers: int = 1500
    reservations: int = 4000
    days: int = 365
    end: datetime = datetime(2025, 1, 1)
    seed: int = 42
    brand: str = "Motorpool"

    @property
    def start(self) -> datetime:
        return self.end - timedelta(days=self.days)


SITE = ("S", 3)
CLASS = ("VC", 3)
VEHICLE = ("V", 5)
CUSTOMER = ("C", 6)


def _key(kind: tuple[str, int], number: Column) -> Column:
    return formatted_key(*kind, number)


def _rows(spark: SparkSession, count: int) -> DataFrame:
    return spark.range(1, count + 1).withColumnRenamed("id", "n")


def _day(base: datetime, offset: Column) -> Column:
    return F.date_add(F.lit(base.date()), offset.cast("int"))


def _moment(size: Size, d: Draws, purpose: str) -> Column:
    """A second of the history window."""
    span = int((size.end - size.start).total_seconds())
    return F.timestamp_seconds(F.lit(_epoch(size.start)) + d.integer(purpose, 0, span))


def _epoch(moment: datetime) -> int:
    return int((moment - datetime(1970, 1, 1)).total_seconds())


def _plus(moment: Column, **parts: Column) -> Column:
    units = {k: p.cast("int") for k, p in parts.items()}
    return moment + F.make_dt_interval(**units)


def _raw(df: DataFrame, entity: str) -> DataFrame:
    """The entity's columns in their declared order, times as ISO text."""
    declared = EVENT if entity == EVENT.name else ENTITIES[entity]
    out = []
    for column, dtype in declared.types.items():
        col = F.col(column)
        if dtype == "timestamp":
            col = calendar.format_iso(col)
        elif dtype == "date":
            col = col.cast("string")
        else:
            col = col.cast(dtype)
        out.append(col.alias(column))
    return df.select(*out)


def vehicle_classes(spark: SparkSession) -> DataFrame:
    """The rate card: one row per class."""
    columns = "class_name string, category string, daily_base_rate_usd double, seats int, is_ev boolean, n int"
    rows = [(*line, i) for i, line in enumerate(v.RATE_CARD, start=1)]
    card = spark.createDataFrame(rows, columns).withColumn("vehicle_class_id", _key(CLASS, F.col("n")))
    return _raw(card, "vehicle_classes")


def _coordinates(number: Column, size: Size) -> tuple[Column, Column]:
    """Where site ``number`` lies: its city, with a small shift of its own."""
    d = Draws(size.seed, "sites", number)
    city = F.pmod(number - 1, F.lit(len(v.CITIES)))
    lat = _nth([c[2] for c in v.CITIES], city) + d.normal("latitude", 0.02)
    lon = _nth([c[3] for c in v.CITIES], city) + d.normal("longitude", 0.02)
    return F.round(lat, 5), F.round(lon, 5)


def _nth(items: Sequence[object], position: Column) -> Column:
    """The item at a position counted from 0."""
    return F.element_at(F.array(*[F.lit(i) for i in items]), (position + 1).cast("int"))


def sites(spark: SparkSession, size: Size) -> DataFrame:
    """One site per city, then further rounds through the cities until there are enough."""
    n = F.col("n")
    d = Draws(size.seed, "sites", n)
    city, visit = F.pmod(n - 1, F.lit(len(v.CITIES))), F.floor((n - 1) / len(v.CITIES))
    name, state = _nth([c[0] for c in v.CITIES], city), _nth([c[1] for c in v.CITIES], city)
    first = n == 1
    suffix = F.when(first, v.HEADQUARTERS_SUFFIX).otherwise(
        _nth(v.SITE_SUFFIXES, F.pmod(visit, F.lit(len(v.SITE_SUFFIXES))))
    )
    lat, lon = _coordinates(n, size)
    df = _rows(spark, size.sites).select(
        _key(SITE, n).alias("site_id"),
        F.concat(state, F.lpad(n.cast("string"), 3, "0")).alias("site_code"),
        F.concat_ws(" ", F.lit(size.brand), name, suffix).alias("site_name"),
        name.alias("city"),
        state.alias("state"),
        lat.alias("latitude"),
        lon.alias("longitude"),
        first.alias("is_hq"),
        d.integer("parking", 40, 200).alias("parking_capacity"),
        _day(datetime(2015, 1, 1), d.integer("opened", 0, 2500)).alias("opened_date"),
    )
    return _raw(df, "sites")


def _vehicle_parts(number: Column, size: Size) -> dict[str, Column]:
    """What other tables need to know about a vehicle, from its number alone."""
    d = Draws(size.seed, "vehicles", number)
    home = d.integer("home", 1, size.sites + 1)
    away = d.integer("away", 1, size.sites + 1)
    return {
        "home": home,
        "current": F.when(d.chance("stays", v.AT_HOME), home).otherwise(away),
        "status": d.weighted("status", v.VEHICLE_STATUS),
        "odometer": d.integer("odometer", 1500, 90000),
        "class": F.pmod(number - 1, F.lit(len(v.RATE_CARD))) + 1,
    }


def vehicles(spark: SparkSession, size: Size) -> DataFrame:
    n = F.col("n")
    d = Draws(size.seed, "vehicles", n)
    parts = _vehicle_parts(n, size)
    choices = [v.MODELS[line[1]] for line in v.RATE_CARD]
    of_class = F.element_at(
        F.array(*[F.array(*[F.struct(F.lit(a).alias("make"), F.lit(b).alias("model")) for a, b in c]) for c in choices]),
        parts["class"].cast("int"),
    )
    car = F.element_at(of_class, (F.floor(d.uniform("model") * F.size(of_class)) + 1).cast("int"))
    letters = [d.pick(f"letter{i}", v.LETTERS) for i in range(3)]
    plate = F.concat(*letters, F.lit("-"), d.integer("plate", 100, 1000).cast("string"))
    df = _rows(spark, size.vehicles).select(
        _key(VEHICLE, n).alias("vehicle_id"),
        F.concat(F.lit("SYNVIN"), F.lpad(n.cast("string"), 11, "0")).alias("vin"),
        _key(CLASS, parts["class"]).alias("vehicle_class_id"),
        car["make"].alias("make"),
        car["model"].alias("model"),
        d.integer("year", 2019, 2025).alias("model_year"),
        d.pick("color", v.COLORS).alias("color"),
        plate.alias("license_plate"),
        _key(SITE, parts["home"]).alias("home_site_id"),
        _key(SITE, parts["current"]).alias("current_site_id"),
        parts["status"].alias("status"),
        parts["odometer"].alias("odometer_miles"),
        _day(datetime(2019, 1, 1), d.integer("acquired", 0, 1800)).alias("acquired_date"),
    )
    return _raw(df, "vehicles")


def customers(spark: SparkSession, size: Size) -> DataFrame:
    """Customers with made-up names, mail addresses and phone numbers."""
    n = F.col("n")
    d = Draws(size.seed, "customers", n)
    first, last = d.pick("first", v.FIRST_NAMES), d.pick("last", v.LAST_NAMES)
    served = v.CITIES[: size.sites]
    city = d.integer("city", 0, len(served))
    email = F.concat(F.lower(first), F.lit("."), F.lower(last), n.cast("string"), F.lit("@example.com"))
    phone = F.format_string("+1-555-%03d-%04d", d.integer("exchange", 100, 999), d.integer("line", 1000, 9999))
    df = _rows(spark, size.customers).select(
        _key(CUSTOMER, n).alias("customer_id"),
        first.alias("first_name"),
        last.alias("last_name"),
        email.alias("email"),
        phone.alias("phone"),
        d.weighted("tier", v.LOYALTY).alias("loyalty_tier"),
        _nth([c[0] for c in served], city).alias("home_city"),
        _nth([c[1] for c in served], city).alias("home_state"),
        _day(datetime(2018, 1, 1), d.integer("joined", 0, 2400)).alias("join_date"),
    )
    return _raw(df, "customers")


def _trip_sites(d: Draws, size: Size) -> tuple[Column, Column]:
    """Pickup and return site; some trips end at a site of their own draw."""
    pickup = d.integer("pickup_site", 1, size.sites + 1)
    other = d.integer("return_site", 1, size.sites + 1)
    return pickup, F.when(d.chance("one_way", v.ONE_WAY), other).otherwise(pickup)


def _bookings(spark: SparkSession, size: Size) -> DataFrame:
    """Reservations with typed columns and their number; rentals are derived from these."""
    n = F.col("n")
    d = Draws(size.seed, "reservations", n)
    pickup_site, return_site = _trip_sites(d, size)
    reserved = _moment(size, d, "reserved_at")
    pickup = F.date_add(reserved.cast("date"), d.integer("lead", 1, 30).cast("int"))
    return _rows(spark, size.reservations).select(
        "n",
        formatted_key("R", 7, n).alias("reservation_id"),
        _key(CUSTOMER, d.integer("customer", 1, size.customers + 1)).alias("customer_id"),
        d.integer("class", 1, len(v.RATE_CARD) + 1).alias("class_no"),
        pickup_site.alias("pickup_no"),
        return_site.alias("return_no"),
        reserved.alias("reserved_at"),
        pickup.alias("pickup_date"),
        F.date_add(pickup, d.integer("length", 1, 14).cast("int")).alias("planned_return_date"),
        d.weighted("status", v.RESERVATION_STATUS).alias("status"),
    )


def _named(df: DataFrame) -> DataFrame:
    """Numbers of classes and sites as keys."""
    return df.withColumns(
        {
            "vehicle_class_id": _key(CLASS, F.col("class_no")),
            "pickup_site_id": _key(SITE, F.col("pickup_no")),
            "return_site_id": _key(SITE, F.col("return_no")),
        }
    )


def reservations(spark: SparkSession, size: Size) -> DataFrame:
    return _raw(_named(_bookings(spark, size)), "reservations")


def _vehicle_of_class(d: Draws, class_no: Column, size: Size) -> Column:
    """A vehicle of the class, or any vehicle when the class has none."""
    classes = len(v.RATE_CARD)
    in_class = F.floor((F.lit(size.vehicles) - class_no) / classes) + 1
    chosen = class_no + classes * d.integer("vehicle", 0, F.greatest(in_class, F.lit(1)))
    return F.when(in_class > 0, chosen).otherwise(d.integer("any_vehicle", 1, size.vehicles + 1))


def _hours(d: Draws, purpose: str) -> Column:
    return d.integer(purpose, 7, 20)


def rentals(spark: SparkSession, size: Size) -> DataFrame:
    """Fulfilled reservations and a tenth as many walk-ins.

    A rental keeps the number of its reservation and walk-ins count on from there, so numbers
    are unique without ranking the rows. Should no trip end elsewhere, the first one is made to.
    Both rules need a count of the rows, which is taken when the table is described.
    """
    booked = _bookings(spark, size).filter("status = 'fulfilled'")
    met = booked.agg(F.count("*").alias("rows")).first()["rows"]
    walked = _walk_ins(spark, size, max(1, int(met * v.WALK_INS)))
    n, d = F.col("n"), Draws(size.seed, "rentals", F.col("n"))
    planned_pickup = _plus(F.col("pickup_date").cast("timestamp"), hours=_hours(d, "pickup_hour"))
    planned_return = _plus(F.col("planned_return_date").cast("timestamp"), hours=_hours(d, "return_hour"))
    out = booked.withColumns(
        {
            "pickup_ts": planned_pickup,
            "planned_return_ts": planned_return,
            "is_open": d.chance("still_out", v.STILL_OUT),
        }
    )
    both = out.unionByName(walked, allowMissingColumns=True)
    miles = d.integer("miles", 40, 1800)
    closed = ~F.col("is_open")
    trips = both.withColumns(
        {
            "rental_id": formatted_key("RN", 8, n),
            "vehicle_id": _key(VEHICLE, _vehicle_of_class(d, F.col("class_no"), size)),
            "return_ts": F.when(closed, _plus(F.col("planned_return_ts"), hours=d.integer("late", -12, 36))),
            "odometer_out": d.integer("odometer", 2000, 85000),
            "miles_driven": F.when(closed, miles),
            "status": F.when(closed, "closed").otherwise("open"),
        }
    ).withColumn("odometer_in", F.col("odometer_out") + F.col("miles_driven"))
    trips = _some_one_way(trips, size).withColumn("is_one_way", F.col("pickup_no") != F.col("return_no"))
    return _raw(_named(trips), "rentals")


def _walk_ins(spark: SparkSession, size: Size, count: int) -> DataFrame:
    n = F.col("n")
    d = Draws(size.seed, "walk_ins", n)
    pickup_site, return_site = _trip_sites(d, size)
    pickup = _plus(_moment(size, d, "pickup"), hours=_hours(d, "pickup_hour"))
    first = size.reservations + 1
    return spark.range(first, first + count).withColumnRenamed("id", "n").select(
        "n",
        F.lit(None).cast("string").alias("reservation_id"),
        _key(CUSTOMER, d.integer("customer", 1, size.customers + 1)).alias("customer_id"),
        d.integer("class", 1, len(v.RATE_CARD) + 1).alias("class_no"),
        pickup_site.alias("pickup_no"),
        return_site.alias("return_no"),
        pickup.alias("pickup_ts"),
        _plus(pickup, days=d.integer("length", 1, 10)).alias("planned_return_ts"),
        F.lit(False).alias("is_open"),
    )


def _some_one_way(trips: DataFrame, size: Size) -> DataFrame:
    if size.sites < 2:
        return trips
    found = trips.agg(
        F.count_if(F.col("pickup_no") != F.col("return_no")).alias("one_way"), F.min("n").alias("first")
    ).first()
    if found["one_way"]:
        return trips
    moved = F.pmod(F.col("pickup_no"), F.lit(size.sites)) + 1
    return trips.withColumn("return_no", F.when(F.col("n") == found["first"], moved).otherwise(F.col("return_no")))


def payments(rentals_raw: DataFrame, classes: DataFrame, size: Size) -> DataFrame:
    """One payment per closed rental, priced from its class and its elapsed days."""
    number = F.regexp_extract("rental_id", r"(\d+)$", 1).cast("long")
    d = Draws(size.seed, "payments", F.col("n"))
    rates = classes.select("vehicle_class_id", "daily_base_rate_usd")
    start, end = calendar.parse_iso("pickup_ts"), calendar.parse_iso("return_ts")
    days = calendar.rental_days_elapsed(F.col("_start"), F.col("_end"))
    rate = F.coalesce("daily_base_rate_usd", F.lit(v.DEFAULT_RATE_USD))
    closed = rentals_raw.filter("status = 'closed'").withColumns({"n": number, "_start": start, "_end": end})
    priced = (
        closed.join(rates, "vehicle_class_id", "left")
        .withColumn("rental_days", days)
        .withColumns(price_columns(rate, F.col("rental_days"), F.col("is_one_way")))
    )
    return _raw(
        priced.withColumns(
            {
                "payment_id": formatted_key("P", 8, F.col("n")),
                "currency": F.lit("USD"),
                "payment_method": d.pick("method", v.PAYMENT_METHODS),
                "payment_ts": _plus(F.col("_end"), mins=d.integer("delay", 5, 120)),
                "status": F.lit("captured"),
            }
        ),
        "payments",
    )


def maintenance(spark: SparkSession, size: Size) -> DataFrame:
    """A Poisson number of repairs per vehicle, numbered by vehicle and visit.

    Should no vehicle have any, the first one gets a single closed oil change.
    """
    made = _repairs(spark, size)
    if made.isEmpty():
        made = _one_repair(spark, size)
    return _raw(made, "maintenance")


def _repairs(spark: SparkSession, size: Size) -> DataFrame:
    n = F.col("n")
    count = Draws(size.seed, "maintenance", n).poisson("visits", v.REPAIRS_PER_VEHICLE)
    visits = (
        _rows(spark, size.vehicles)
        .withColumn("_count", count)
        .filter("_count > 0")
        .withColumn("visit", F.explode(F.sequence(F.lit(1), F.col("_count"))))
        # Numbered along the diagonals of (vehicle, visit): no two pairs meet, however many visits there are.
        .withColumn("m", _diagonal(F.col("n"), F.col("visit").cast("long")))
    )
    d = Draws(size.seed, "maintenance", F.col("m"))
    vehicle = _vehicle_parts(n, size)
    kind = d.pick("type", v.MAINTENANCE_TYPES)
    labor, parts = d.integer("labor", 80, 900).cast("double"), d.integer("parts", 20, 1500).cast("double")
    opened = _moment(size, d, "opened")
    still_open = d.chance("open", v.REPAIR_OPEN)
    return visits.select(
        formatted_key("M", 7, F.col("m")).alias("maintenance_id"),
        _key(VEHICLE, n).alias("vehicle_id"),
        _key(SITE, vehicle["current"]).alias("site_id"),
        kind.alias("maintenance_type"),
        F.when(kind.isin(*v.FAULT_TYPES), d.pick("fault", v.FAULT_CODES)).alias("fault_code"),
        opened.alias("opened_ts"),
        F.when(~still_open, _plus(opened, hours=d.integer("duration", 2, 96))).alias("closed_ts"),
        labor.alias("labor_cost_usd"),
        parts.alias("parts_cost_usd"),
        (labor + parts).alias("total_cost_usd"),
        (vehicle["odometer"] - d.integer("since", 0, 5000)).alias("odometer_at_service"),
        F.when(still_open, "open").otherwise("closed").alias("status"),
    )


def _diagonal(a: Column, b: Column) -> Column:
    return F.shiftright((a + b) * (a + b + 1), 1) + b


def _one_repair(spark: SparkSession, size: Size) -> DataFrame:
    vehicle = _vehicle_parts(F.col("n"), size)
    opened = F.timestamp_seconds(F.lit(_epoch(size.start)))
    return _rows(spark, 1).select(
        formatted_key("M", 7, F.lit(1)).alias("maintenance_id"),
        _key(VEHICLE, F.col("n")).alias("vehicle_id"),
        _key(SITE, vehicle["current"]).alias("site_id"),
        F.lit(v.FALLBACK_REPAIR[0]).alias("maintenance_type"),
        F.lit(None).cast("string").alias("fault_code"),
        opened.alias("opened_ts"),
        _plus(opened, hours=F.lit(3)).alias("closed_ts"),
        F.lit(v.FALLBACK_REPAIR[1]).alias("labor_cost_usd"),
        F.lit(v.FALLBACK_REPAIR[2]).alias("parts_cost_usd"),
        F.lit(sum(v.FALLBACK_REPAIR[1:])).alias("total_cost_usd"),
        vehicle["odometer"].alias("odometer_at_service"),
        F.lit("closed").alias("status"),
    )


def telematics(spark: SparkSession, size: Size) -> DataFrame:
    """One snapshot per vehicle at the end of the window; idle time follows the vehicle's status."""
    n = F.col("n")
    d = Draws(size.seed, "telematics", n)
    vehicle = _vehicle_parts(n, size)
    status = vehicle["status"]
    idle = d.integer("idle", *v.SNAPSHOT_IDLE_DEFAULT)
    for name, (low, high) in v.SNAPSHOT_IDLE.items():
        idle = F.when(status == name, d.integer("idle", low, high)).otherwise(idle)
    on = status == "rented"
    faulty = (status == "maintenance") | d.chance("faulty", v.SNAPSHOT_FAULTS)
    lat, lon = _coordinates(vehicle["current"], size)
    df = _rows(spark, size.vehicles).select(
        formatted_key("T", 6, n).alias("telematics_id"),
        _key(VEHICLE, n).alias("vehicle_id"),
        _key(SITE, vehicle["current"]).alias("site_id"),
        F.timestamp_seconds(F.lit(_epoch(size.end))).alias("snapshot_ts"),
        F.when(on, "on").otherwise("off").alias("ignition_state"),
        idle.alias("idle_minutes"),
        vehicle["odometer"].alias("odometer_miles"),
        F.when(faulty, d.pick("fault", v.FAULT_CODES)).alias("fault_code"),
        F.round(lat + d.normal("latitude", 0.01), 5).alias("latitude"),
        F.round(lon + d.normal("longitude", 0.01), 5).alias("longitude"),
        F.when(on, d.integer("speed", 0, 75)).otherwise(0).alias("speed_mph"),
        d.integer("fuel", 5, 100).alias("fuel_or_soc_pct"),
    )
    return _raw(df, "telematics")


def entities(spark: SparkSession, size: Size) -> dict[str, DataFrame]:
    """All nine raw entities, in dependency order."""
    classes, trips = vehicle_classes(spark), rentals(spark, size)
    return {
        "vehicle_classes": classes,
        "sites": sites(spark, size),
        "vehicles": vehicles(spark, size),
        "customers": customers(spark, size),
        "reservations": reservations(spark, size),
        "rentals": trips,
        "payments": payments(trips, classes, size),
        "maintenance": maintenance(spark, size),
        "telematics": telematics(spark, size),
    }


@dataclass(frozen=True)
class Spike:
    """A burst in the event feed: ``fraction`` of the events from ``start`` on, for ``duration`` events."""

    start: int
    duration: int
    kind: str = "both"
    fraction: float = 0.5

    @staticmethod
    def of(count: int) -> Spike:
        """The usual burst: two fifths into the feed, a quarter of its length."""
        return Spike(int(count * 0.4), max(1, int(count * 0.25)))


def events(
    spark: SparkSession,
    size: Size,
    count: int,
    start: datetime,
    step_seconds: float = 1.0,
    spike: Spike | None = None,
) -> DataFrame:
    """A feed of readings, calm except during the spike, one every ``step_seconds``."""
    i = F.col("i")
    d = Draws(size.seed, "events", i)
    number = d.integer("vehicle", 1, size.vehicles + 1)
    vehicle = _vehicle_parts(number, size)
    lat, lon = _coordinates(vehicle["current"], size)
    elevated, idling, failing = F.lit(False), F.lit(False), F.lit(False)
    if spike is not None:
        inside = i.between(spike.start, spike.start + spike.duration - 1)
        elevated = inside & d.chance("elevated", spike.fraction)
        idling = elevated if spike.kind in ("idle", "both") else idling
        failing = elevated if spike.kind in ("fault", "both") else failing
    on = ~idling & d.chance("ignition", v.EVENT_IGNITION_ON)
    high = d.integer("long_idle", IDLE_LIMIT_MINUTES + 60, IDLE_LIMIT_MINUTES + 720)
    micros = F.lit(_epoch(start) * 1_000_000) + F.floor(i * F.lit(step_seconds * 1_000_000))
    df = spark.range(count).withColumnRenamed("id", "i").select(
        d.uuid("event").alias("event_id"),
        _key(VEHICLE, number).alias("vehicle_id"),
        _key(SITE, vehicle["current"]).alias("site_id"),
        F.timestamp_micros(micros).alias("ts"),
        F.when(on, "on").otherwise("off").alias("ignition_state"),
        F.when(idling, high).otherwise(d.integer("idle", 0, 45)).alias("idle_minutes"),
        (vehicle["odometer"] + d.integer("driven", 0, 50)).alias("odometer_miles"),
        F.when(failing | d.chance("faulty", v.EVENT_FAULTS), d.pick("fault", v.FAULT_CODES)).alias("fault_code"),
        F.round(lat + d.normal("latitude", 0.005), 5).alias("latitude"),
        F.round(lon + d.normal("longitude", 0.005), 5).alias("longitude"),
        F.when(on, d.integer("speed", 0, 70)).otherwise(0).alias("speed_mph"),
        d.integer("fuel", 5, 100).alias("fuel_or_soc_pct"),
        elevated.alias("is_spike"),
    )
    return _raw(df, EVENT.name)


def write_events(df: DataFrame, directory: str, files: int | None = None) -> None:
    """Write the feed as newline-delimited JSON, nulls included."""
    out = df.repartitionByRange(files, "ts") if files else df
    out.write.mode("overwrite").option("ignoreNullFields", "false").json(directory)
