from __future__ import annotations

from pyspark.sql import functions as F

from motorpool.operators import gold
from motorpool.plans import medallion
from tests.conftest import rows


def test_two_payments_do_not_multiply_the_rental(golden):
    got = rows(golden["fact_rental"], "rental_id", "revenue_usd", "base_amount_usd")
    assert got == [
        ("R1", 45.4, 40.0),
        ("R2", 45.4, 40.0),
        ("R3", 0.0, None),
        ("R4", 402.93, 280.0),
        ("R5", 0.0, None),
        ("R6", 175.93, 80.0),
    ]


def test_fact_total_is_payment_total(silver, golden):
    paid = silver["payments"].agg(F.sum("total_amount_usd")).first()[0]
    assert round(golden["fact_rental"].agg(F.sum("revenue_usd")).first()[0], 2) == round(paid, 2)


def test_class_comes_from_the_vehicle_not_the_booking(golden):
    got = dict(rows(golden["fact_rental"], "rental_id", "class_name"))
    assert got["R1"] == "Economy"
    assert got["R6"] is None


def test_fact_has_both_site_roles(golden):
    got = rows(golden["fact_rental"].filter("is_one_way"), "rental_id", "pickup_city", "return_city", "pickup_state")
    assert got == [("R4", "Aville", "Btown", "WA"), ("R6", "Btown", "Aville", "OR")]


def test_fact_makes_only_the_joins_it_needs(silver):
    lean = medallion.fact(silver, ("rental_id", "pickup_ts"))
    plan = lean._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    full = medallion.fact(silver)
    assert rows(full, "rental_id", "pickup_ts") == rows(lean)


def test_revenue_by_site_counts_unpaid_rentals_as_zero(golden):
    got = rows(golden["kpi_revenue_by_site"])
    assert got == [
        ("S1", "North", "Aville", "WA", 3, 493.73, 164.58, 1.7),
        ("S2", "South", "Btown", "OR", 3, 175.93, 58.64, 17.0),
    ]


def test_fleet_utilization_by_class(golden):
    got = rows(golden["kpi_fleet_utilization"], "vehicle_class_id", "total_rentals", "total_rented_days", "fleet_size")
    assert got == [("K1", 3, 34, 2), ("K2", 2, 3, 1), (None, 1, 2, None)]
    ratio = rows(golden["kpi_fleet_utilization"], "vehicle_class_id", "rentals_per_vehicle")
    assert ratio == [("K1", 1.5), ("K2", 2.0), (None, None)]


def test_one_way_flows(golden):
    got = rows(golden["kpi_one_way_flows"], "pickup_site_id", "return_site_id", "one_way_trips", "one_way_revenue_usd")
    assert got == [("S1", "S2", 1, 402.93), ("S2", "S1", 1, 175.93)]


def test_maintenance_cost_keeps_unknown_sites(golden):
    got = rows(golden["kpi_maintenance_cost"], "site_id", "site_name", "maintenance_events", "total_maintenance_cost_usd")
    assert got == [("S1", "North", 2, 165.75), ("S9", None, 1, 3.0)]


def test_dim_vehicle_of_unknown_class(golden):
    got = dict(rows(golden["dim_vehicle"], "vehicle_id", "category"))
    assert got == {"V1": "Car", "V2": "Car", "V3": "Van", "V4": None}


def test_curated_rentals(silver):
    got = rows(gold.rentals_curated(silver["rentals"], silver["sites"]), "rental_id", "site_city", "site_state")
    assert got[0] == ("R1", "Aville", "WA") and len(got) == 6
