"""The star schema and its KPI tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorpool.functions.money import safe_div, usd_avg, usd_sum
from motorpool.operators.filters import one_way
from motorpool.operators.joins import lookup, role_dim

# The columns of the dimensions and the fact.
DIM_SITE = (
    "site_id",
    "site_code",
    "site_name",
    "city",
    "state",
    "latitude",
    "longitude",
    "is_hq",
    "parking_capacity",
    "opened_date",
)
DIM_CUSTOMER = (
    "customer_id",
    "first_name",
    "last_name",
    "email",
    "phone",
    "loyalty_tier",
    "home_city",
    "home_state",
    "join_date",
)
VEHICLE_OWN = (
    "vehicle_id",
    "vin",
    "make",
    "model",
    "model_year",
    "color",
    "license_plate",
    "status",
    "odometer_miles",
    "acquired_date",
    "home_site_id",
    "current_site_id",
    "vehicle_class_id",
)
CLASS_OWN = ("class_name", "category", "daily_base_rate_usd", "seats", "is_ev")

PICKUP_ROLE = {
    "site_id": "pickup_site_id",
    "site_name": "pickup_site_name",
    "city": "pickup_city",
    "state": "pickup_state",
}
RETURN_ROLE = {"site_id": "return_site_id", "site_name": "return_site_name", "city": "return_city"}
AMOUNTS = ("base_amount_usd", "one_way_fee_usd", "taxes_fees_usd")

FACT_RENTAL = (
    "rental_id",
    "reservation_id",
    "customer_id",
    "vehicle_id",
    "vehicle_class_id",
    "class_name",
    "category",
    "pickup_site_id",
    "pickup_site_name",
    "pickup_city",
    "pickup_state",
    "return_site_id",
    "return_site_name",
    "return_city",
    "pickup_ts",
    "return_ts",
    "rental_days",
    "miles_driven",
    "is_one_way",
    "status",
    "revenue_usd",
    *AMOUNTS,
)


def dim_site(sites: DataFrame) -> DataFrame:
    return sites.select(*DIM_SITE)


def dim_customer(customers: DataFrame) -> DataFrame:
    return customers.select(*DIM_CUSTOMER)


def dim_vehicle(vehicles: DataFrame, classes: DataFrame) -> DataFrame:
    """Vehicles with their rate-card class; a vehicle of unknown class keeps null attributes."""
    rate_card = classes.select("vehicle_class_id", *CLASS_OWN)
    return lookup(vehicles.select(*VEHICLE_OWN), rate_card, "vehicle_class_id")


def payments_by_rental(payments: DataFrame) -> DataFrame:
    """Payments rolled up to one row per rental."""
    totals = {"total_amount_usd": "revenue_usd", **{a: a for a in AMOUNTS}}
    return payments.groupBy("rental_id").agg(*[usd_sum(c).alias(a) for c, a in totals.items()])


def fact_rental(
    rentals: DataFrame,
    payments: DataFrame,
    sites: DataFrame,
    vehicles: DataFrame,
    classes: DataFrame,
    columns: Sequence[str] = FACT_RENTAL,
) -> DataFrame:
    """One row per rental with its revenue, sites and vehicle class.

    Only the joins that ``columns`` need are made: every side is unique on its key, so leaving
    one out cannot change the rows. Class attributes come from the vehicle handed over, not
    from the class that was booked. The two joins that may move the rentals come first, while
    rows are narrow; site names are added last.
    """
    wanted = set(columns)
    fact = rentals.drop("vehicle_class_id")
    if wanted & {"revenue_usd", *AMOUNTS}:
        fact = fact.join(payments_by_rental(payments), "rental_id", "left")
        fact = fact.withColumn("revenue_usd", F.coalesce("revenue_usd", F.lit(0.0)))
    if wanted & {"vehicle_class_id", "class_name", "category"}:
        of_vehicle = vehicles.select("vehicle_id", "vehicle_class_id")
        if wanted & {"class_name", "category"}:
            names = classes.select("vehicle_class_id", "class_name", "category")
            of_vehicle = lookup(of_vehicle, names, "vehicle_class_id")
        fact = lookup(fact, of_vehicle, "vehicle_id", spread_nulls_by="rental_id")
    if wanted & {"pickup_site_name", "pickup_city", "pickup_state"}:
        fact = lookup(fact, role_dim(sites, PICKUP_ROLE), "pickup_site_id")
    if wanted & {"return_site_name", "return_city"}:
        fact = lookup(fact, role_dim(sites, RETURN_ROLE), "return_site_id")
    return fact.select(*columns)


def rental_count(unique: bool) -> Column:
    """How many rentals a group has.

    ``unique`` promises one row per rental, as :func:`fact_rental` gives it over cleaned tables.
    Rentals are then counted row by row; without the promise their ids have to be shuffled.
    """
    return F.count("rental_id") if unique else F.count_distinct("rental_id")


def rental_totals(fact: DataFrame, by: Sequence[str], unique: bool = False) -> DataFrame:
    """Rentals, revenue and mean length per group."""
    return fact.groupBy(*by).agg(
        rental_count(unique).alias("total_rentals"),
        usd_sum("revenue_usd").alias("total_revenue_usd"),
        usd_avg("revenue_usd").alias("avg_revenue_per_rental_usd"),
        F.round(F.avg("rental_days"), 1).alias("avg_rental_days"),
    )


def kpi_revenue_by_site(fact: DataFrame, unique: bool = False) -> DataFrame:
    return rental_totals(fact, list(PICKUP_ROLE.values()), unique)


def rented_days_by_class(fact: DataFrame, unique: bool = False) -> DataFrame:
    return fact.groupBy("vehicle_class_id", "class_name", "category").agg(
        rental_count(unique).alias("total_rentals"),
        F.sum("rental_days").alias("total_rented_days"),
        F.round(F.avg("rental_days"), 1).alias("avg_rental_days"),
    )


def fleet_size(vehicles: DataFrame, by: str) -> DataFrame:
    return vehicles.groupBy(by).agg(F.count_distinct("vehicle_id").alias("fleet_size"))


def kpi_fleet_utilization(fact: DataFrame, vehicles: DataFrame, unique: bool = False) -> DataFrame:
    fleet = fleet_size(vehicles, "vehicle_class_id")
    joined = rented_days_by_class(fact, unique).join(fleet, "vehicle_class_id", "left")
    per_vehicle = F.round(safe_div(F.col("total_rentals"), F.col("fleet_size")), 2)
    return joined.withColumn("rentals_per_vehicle", per_vehicle)


def kpi_one_way_flows(fact: DataFrame, unique: bool = False) -> DataFrame:
    ends = ["pickup_site_id", "pickup_site_name", "pickup_city", *RETURN_ROLE.values()]
    return (
        one_way(fact)
        .groupBy(*ends)
        .agg(
            rental_count(unique).alias("one_way_trips"),
            usd_sum("revenue_usd").alias("one_way_revenue_usd"),
        )
    )


def maintenance_totals(maintenance: DataFrame, by: str = "site_id") -> DataFrame:
    """Events and cost per site, or per vehicle with ``by="vehicle_id"``."""
    return maintenance.groupBy(by).agg(
        F.count("maintenance_id").alias("maintenance_events"),
        usd_sum("total_cost_usd").alias("total_maintenance_cost_usd"),
        usd_sum("labor_cost_usd").alias("total_labor_cost_usd"),
        usd_sum("parts_cost_usd").alias("total_parts_cost_usd"),
    )


def kpi_maintenance_cost(maintenance: DataFrame, sites: DataFrame) -> DataFrame:
    """Maintenance totals per site. Events are summed by site before the site is looked up."""
    names = {"site_id": "site_id", "site_name": "site_name", "city": "site_city", "state": "site_state"}
    return lookup(maintenance_totals(maintenance), role_dim(sites, names), "site_id")


def payment_revenue(payments: DataFrame, by: str = "pickup_site_id") -> DataFrame:
    """Revenue straight from payments, by the site they carry; the fact gives the same by rental."""
    return payments.groupBy(by).agg(
        F.count("payment_id").alias("payments"),
        usd_sum("total_amount_usd").alias("total_revenue_usd"),
    )


def rentals_curated(rentals: DataFrame, sites: DataFrame) -> DataFrame:
    """Rentals with the city and state of their pickup site."""
    place = role_dim(sites, {"site_id": "pickup_site_id", "city": "site_city", "state": "site_state"})
    return lookup(rentals, place, "pickup_site_id").select(
        "rental_id",
        "vehicle_id",
        "customer_id",
        "pickup_site_id",
        "return_site_id",
        "site_city",
        "site_state",
        "pickup_ts",
        "return_ts",
        "miles_driven",
        "rental_days",
        "is_one_way",
        "status",
    )
