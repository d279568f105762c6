"""A small hand-made fleet, written so that each odd case occurs once."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import SparkSession

from motorpool.plans import medallion
from motorpool.session import configure


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return configure(session)


def rows(df, *columns):
    """Rows as sorted tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def ts(text):
    return datetime.fromisoformat(text)


@pytest.fixture(scope="session")
def silver(spark):
    """Cleaned tables. S3 has no vehicles and no rentals."""
    sites = spark.createDataFrame(
        [
            ("S1", "WA001", "North", "Aville", "WA", 1.0, 2.0, True, 50, date(2020, 1, 1)),
            ("S2", "OR002", "South", "Btown", "OR", 3.0, 4.0, False, 60, date(2020, 1, 1)),
            ("S3", "OR003", "Empty", "Ctown", "OR", 5.0, 6.0, False, 70, date(2020, 1, 1)),
        ],
        "site_id string, site_code string, site_name string, city string, state string, latitude double,"
        " longitude double, is_hq boolean, parking_capacity int, opened_date date",
    )
    classes = spark.createDataFrame(
        [("K1", "Economy", "Car", 40.0, 5, False), ("K2", "Van", "Van", 90.0, 7, False)],
        "vehicle_class_id string, class_name string, category string, daily_base_rate_usd double, seats int,"
        " is_ev boolean",
    )
    vehicles = spark.createDataFrame(
        [
            ("V1", "x1", "K1", "m", "a", 2020, "Red", "p1", "S1", "S1", "idle", 100, date(2020, 1, 1)),
            ("V2", "x2", "K1", "m", "b", 2021, "Red", "p2", "S1", "S2", "maintenance", 200, date(2020, 1, 1)),
            ("V3", "x3", "K2", "n", "c", 2022, "Blue", "p3", "S2", "S2", "rented", 300, date(2020, 1, 1)),
            ("V4", "x4", "K9", "n", "d", 2023, "Blue", "p4", "S2", "S1", "available", 400, date(2020, 1, 1)),
        ],
        "vehicle_id string, vin string, vehicle_class_id string, make string, model string, model_year int,"
        " color string, license_plate string, home_site_id string, current_site_id string, status string,"
        " odometer_miles long, acquired_date date",
    )
    customers = spark.createDataFrame(
        [
            ("C1", "Ann", "Lee", "ann@example.com", "+1-555-100-2000", "Gold", "Aville", "WA", date(2020, 1, 1)),
            ("C2", "Bo", "Kim", "bo@example.com", "+1-555-100-2001", "None", "Btown", "OR", date(2020, 1, 1)),
        ],
        "customer_id string, first_name string, last_name string, email string, phone string, loyalty_tier string,"
        " home_city string, home_state string, join_date date",
    )
    rentals = spark.createDataFrame(
        [
            # same-day return: one day by the minimum rule
            ("R1", "B1", "C1", "V1", "K2", "S1", "S1", "2024-01-05T08:00", "2024-01-05T18:00", 50, False, "closed"),
            # crosses midnight in a few hours
            ("R2", None, "C1", "V1", "K1", "S1", "S1", "2024-01-10T22:00", "2024-01-11T02:00", 60, False, "closed"),
            # still out
            ("R3", "B3", "C2", "V3", "K2", "S2", "S2", "2024-01-12T09:00", None, None, False, "open"),
            # one way, two payments
            ("R4", "B4", "C2", "V3", "K2", "S1", "S2", "2024-01-15T09:00", "2024-01-18T09:00", 300, True, "closed"),
            # spans three months, never paid
            ("R5", "B5", "C1", "V2", "K1", "S2", "S2", "2024-01-30T10:00", "2024-03-02T10:00", 900, False, "closed"),
            # vehicle that does not exist
            ("R6", "B6", "C1", "V9", "K1", "S2", "S1", "2024-02-01T10:00", "2024-02-03T10:00", 100, True, "closed"),
        ],
        "rental_id string, reservation_id string, customer_id string, vehicle_id string, vehicle_class_id string,"
        " pickup_site_id string, return_site_id string, pickup_text string, return_text string, miles_driven long,"
        " is_one_way boolean, status string",
    ).selectExpr(
        "*",
        "cast(pickup_text as timestamp) as pickup_ts",
        "cast(return_text as timestamp) as return_ts",
    )
    from motorpool.operators.cleaning import rental_days

    payments = spark.createDataFrame(
        [
            ("P1", "R1", 40.0, 0.0, 5.4, 45.4),
            ("P2", "R2", 40.0, 0.0, 5.4, 45.4),
            ("P3", "R4", 270.0, 75.0, 46.58, 391.58),
            ("P4", "R4", 10.0, 0.0, 1.35, 11.35),
            ("P5", "R6", 80.0, 75.0, 20.93, 175.93),
        ],
        "payment_id string, rental_id string, base_amount_usd double, one_way_fee_usd double, taxes_fees_usd double,"
        " total_amount_usd double",
    )
    maintenance = spark.createDataFrame(
        [("M1", "V1", "S1", 100.0, 50.5, 150.5), ("M2", "V2", "S1", 10.0, 5.25, 15.25), ("M3", "V3", "S9", 1.0, 2.0, 3.0)],
        "maintenance_id string, vehicle_id string, site_id string, labor_cost_usd double, parts_cost_usd double,"
        " total_cost_usd double",
    )
    telematics = spark.createDataFrame(
        [
            ("T1", "V1", "2024-01-01T00:00", 0, 130, 1000),
            ("T2", "V1", "2024-01-01T02:00", 10, 5, 1010),
            ("T3", "V2", "2024-01-01T01:00", 20, 120, 500),
        ],
        "telematics_id string, vehicle_id string, at string, speed_mph int, idle_minutes int, odometer_miles long",
    ).selectExpr("*", "cast(at as timestamp) as snapshot_ts")
    return {
        "sites": sites,
        "vehicle_classes": classes,
        "vehicles": vehicles,
        "customers": customers,
        "rentals": rental_days(rentals),
        "payments": payments,
        "maintenance": maintenance,
        "telematics": telematics,
    }


@pytest.fixture(scope="session")
def golden(silver):
    """Dimensions, fact, KPIs and aggregates over the small fleet."""
    tables = medallion.dimensions(silver)
    tables["fact_rental"] = medallion.fact(silver)
    tables |= medallion.kpis(tables["fact_rental"], silver)
    return tables | medallion.aggregate_tables(tables, silver["telematics"], ts("2024-01-01T03:00"))
