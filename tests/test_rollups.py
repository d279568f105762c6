from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from motorpool.functions import states
from motorpool.operators import ranking, rollups
from motorpool.operators.joins import site_geo
from tests.conftest import rows, ts


def test_revenue_by_site_has_coordinates(golden):
    got = rows(golden["agg_revenue_by_site"], "pickup_site_id", "total_revenue_usd", "latitude", "is_hq")
    assert got == [("S1", 493.73, 1.0, True), ("S2", 175.93, 3.0, False)]


def test_revenue_by_month(golden):
    got = rows(golden["agg_revenue_by_site_month"], "pickup_site_id", "revenue_month", "total_rentals")
    assert got == [("S1", date(2024, 1, 1), 3), ("S2", date(2024, 1, 1), 2), ("S2", date(2024, 2, 1), 1)]


def test_utilization_credits_the_pickup_month_and_may_exceed_100(golden):
    got = rows(
        golden["agg_fleet_utilization_by_site_month"],
        "pickup_site_id",
        F.col("rental_month").cast("string"),
        "total_rented_days",
        "fleet_size",
        "days_in_month",
        "utilization_pct",
    )
    assert got == [
        ("S1", "2024-01-01", 5, 2, 31, 8.1),
        ("S2", "2024-01-01", 32, 2, 31, 51.6),
        ("S2", "2024-02-01", 2, 2, 29, 3.4),
    ]


def test_utilization_of_a_site_without_vehicles_is_null(silver, golden):
    vehicles = silver["vehicles"].filter("current_site_id = 'S1'")
    got = rollups.agg_fleet_utilization_by_site_month(golden["fact_rental"], vehicles, site_geo(silver["sites"]))
    assert {r[0]: r[1] for r in rows(got, "pickup_site_id", "utilization_pct")}["S2"] is None


def test_prorated_days_fall_in_their_months_and_add_up(golden):
    days = rollups.days_by_month(golden["fact_rental"])
    long_one = rows(days.filter("rental_id = 'R5'"), F.col("rental_month").cast("string"), "days")
    assert long_one == [("2024-01-01", 2), ("2024-02-01", 29), ("2024-03-01", 1)]
    totals = dict(rows(days.groupBy("rental_id").agg(F.sum("days"))))
    assert totals == dict(rows(golden["fact_rental"].filter("rental_days is not null"), "rental_id", "rental_days"))


def test_idle_vehicles(golden):
    got = rows(
        golden["agg_idle_vehicles_by_site"],
        "current_site_id",
        "vehicles_at_site",
        "idle_vehicles",
        "rented_vehicles",
        "maintenance_vehicles",
        "idle_ratio_pct",
    )
    assert got == [("S1", 2, 1, 0, 0, 50.0), ("S2", 2, 0, 1, 1, 0.0)]


def test_idle_vehicles_count_each_vehicle_once(silver):
    twice = silver["vehicles"].union(silver["vehicles"])
    geo = site_geo(silver["sites"])
    assert rows(rollups.agg_idle_vehicles_by_site(twice, geo)) == rows(
        rollups.agg_idle_vehicles_by_site(silver["vehicles"], geo)
    )


def test_flows_have_both_ends(golden):
    got = rows(golden["agg_one_way_flows"], "pickup_latitude", "return_latitude", "one_way_trips")
    assert got == [(1.0, 3.0, 1), (3.0, 1.0, 1)]


def test_freshness_at_a_fixed_moment(golden):
    got = rows(
        golden["agg_telematics_freshness"], "vehicle_id", "snapshots", "max_idle_minutes", "minutes_since_last_snapshot"
    )
    assert got == [("V1", 2, 130, 60.0), ("V2", 1, 120, 120.0)]


def test_freshness_defaults_to_now(silver):
    got = rollups.agg_telematics_freshness(silver["telematics"]).agg(F.min("minutes_since_last_snapshot")).first()[0]
    assert got > 100_000


def test_spike_summary_is_closed_on_both_ends(spark):
    df = spark.createDataFrame(
        [(ts("2024-01-01T00:00"), 10, ""), (ts("2024-01-01T00:10"), 20, "P1"), (ts("2024-01-01T00:11"), 99, "P2")],
        "ts timestamp, idle_minutes int, fault_code string",
    )
    assert rows(rollups.spike_summary(df, ts("2024-01-01T00:00"), ts("2024-01-01T00:10"))) == [(15.0, 1)]


def test_drill_tells_totals_from_null_members(golden):
    opened = rollups.drill(golden["fact_rental"], ["pickup_state", "class_name"], {"n": states.row_count()})
    got = rows(opened, "depth", "pickup_state", "class_name", "n")
    assert (0, None, None, 6) in got
    assert (1, "OR", None, 3) in got
    assert (2, "OR", None, 1) in got


def test_top_k_with_and_without_ties(spark):
    df = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3), ("d", 1)], "k string, n int")
    assert rows(ranking.top_k(df, "n", 2, keys=["k"])) == [("a", 5), ("b", 3)]
    assert rows(ranking.top_k(df, "n", 2, ties=True)) == [("a", 5, 1), ("b", 3, 2), ("c", 3, 2)]
    assert [r.k for r in ranking.ordered(df, "n", ["k"]).collect()] == ["a", "b", "c", "d"]


def test_top_k_within_groups(spark):
    df = spark.createDataFrame([("x", "a", 5), ("x", "b", 7), ("y", "c", 1)], "g string, k string, n int")
    assert rows(ranking.top_k(df, "n", 1, keys=["k"], within=["g"]), "g", "k") == [("x", "b"), ("y", "c")]


def test_change_reaches_across_slices_and_gaps(spark):
    data = [
        (1, "v", ts("2024-01-01T23:00"), 10),
        (2, "v", ts("2024-01-01T23:30"), 15),
        (3, "v", ts("2024-01-05T01:00"), 40),
        (4, "v", ts("2024-01-05T01:00"), 41),
        (5, "w", ts("2024-01-03T00:00"), 7),
        (6, None, ts("2024-01-01T00:00"), 10),
        (7, None, ts("2024-01-02T00:00"), 12),
    ]
    df = spark.createDataFrame(data, "id int, key string, ts timestamp, miles long")
    got = rows(ranking.change(df, "key", "ts", "miles", tiebreak="id"), "id", "previous_miles", "miles_change")
    assert got == [(1, None, None), (2, 10, 5), (3, 15, 25), (4, 40, 1), (5, None, None), (6, None, None), (7, 10, 2)]
