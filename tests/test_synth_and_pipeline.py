from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from motorpool.operators import quality
from motorpool.plans import medallion
from motorpool.schemas import ENTITIES
from motorpool.synth import fleet
from motorpool.synth.draws import Draws
from tests.conftest import rows, ts

SIZE = fleet.Size()


@pytest.fixture(scope="module")
def raw(spark):
    return fleet.entities(spark, SIZE)


def share(df, condition):
    got = df.agg(F.avg(F.expr(condition).cast("int"))).first()[0]
    return got


def test_sizes_columns_and_references(raw):
    assert {n: df.columns for n, df in raw.items()} == {n: list(e.columns) for n, e in ENTITIES.items()}
    counts = {n: df.count() for n, df in raw.items()}
    assert counts["vehicle_classes"] == 11
    assert (counts["sites"], counts["vehicles"], counts["customers"], counts["reservations"]) == (18, 600, 1500, 4000)
    quality.require_fks(raw, quality.entity_relations(raw))
    for name, entity in ENTITIES.items():
        got = quality.check_pk(raw[name], entity.key).first()
        assert (got.null_keys, got.repeated_keys) == (0, 0), name
        broken = quality.validate(raw[name], quality.contract_of(entity)).filter("violations > 0")
        assert broken.count() == 0, name


def test_shares_are_near_their_targets(spark):
    size = fleet.Size(vehicles=20_000, customers=20_000, reservations=20_000)
    cars = fleet.vehicles(spark, size)
    assert share(cars, "status = 'idle'") == pytest.approx(0.10, abs=0.01)
    # Some of those that leave draw their home again.
    assert share(cars, "home_site_id = current_site_id") == pytest.approx(0.75 + 0.25 / 18, abs=0.01)
    assert share(fleet.customers(spark, size), "loyalty_tier = 'Gold'") == pytest.approx(0.18, abs=0.01)
    booked = fleet.reservations(spark, size)
    assert share(booked, "status = 'fulfilled'") == pytest.approx(0.72, abs=0.01)
    assert share(booked, "pickup_site_id <> return_site_id") == pytest.approx(0.18 * 17 / 18, abs=0.01)
    trips = fleet.rentals(spark, size)
    assert share(trips, "reservation_id is null") == pytest.approx(0.1 / 1.1, abs=0.01)
    assert share(trips.filter("reservation_id is not null"), "status = 'open'") == pytest.approx(0.08, abs=0.01)
    repairs = fleet.maintenance(spark, size)
    assert repairs.count() / 20_000 == pytest.approx(0.35, abs=0.02)
    assert share(repairs, "status = 'open'") == pytest.approx(0.12, abs=0.015)


def test_draws_do_not_depend_on_partitions(spark):
    def made(parts):
        d = Draws(7, "t", F.col("id"))
        df = spark.range(0, 1000, 1, parts)
        drawn = {"a": d.uniform("a"), "b": d.normal("b", 1.0), "c": d.poisson("c", 0.35), "e": d.uuid("e")}
        return df.withColumns(drawn)

    assert rows(quality.fingerprint(made(1))) == rows(quality.fingerprint(made(13)))


def test_same_seed_same_data_other_seed_other_data(spark, raw):
    again = fleet.entities(spark, SIZE)
    other = fleet.entities(spark, fleet.Size(seed=43))
    for name in ("vehicles", "rentals", "payments", "maintenance"):
        mark = rows(quality.fingerprint(raw[name]))
        assert rows(quality.fingerprint(again[name])) == mark
        assert rows(quality.fingerprint(other[name])) != mark


def test_payments_cover_closed_rentals_and_add_up(raw):
    closed = raw["rentals"].filter("status = 'closed'")
    assert raw["payments"].count() == closed.count()
    wrong = raw["payments"].filter(
        "abs(total_amount_usd - base_amount_usd - one_way_fee_usd - taxes_fees_usd) > 0.005"
        " or abs(taxes_fees_usd - 0.135 * (base_amount_usd + one_way_fee_usd)) > 0.0051"
    )
    assert wrong.count() == 0


def test_rented_vehicles_have_the_class_that_was_booked(raw):
    trip, car = raw["rentals"].alias("r"), raw["vehicles"].alias("v")
    joined = trip.join(car, F.col("r.vehicle_id") == F.col("v.vehicle_id"))
    assert joined.filter("r.vehicle_class_id <> v.vehicle_class_id").count() == 0


def test_tiny_fleet_still_has_a_one_way_trip_and_a_repair(spark):
    size = fleet.Size(sites=2, vehicles=1, customers=1, reservations=3, seed=1)
    made = fleet.entities(spark, size)
    assert made["rentals"].filter("is_one_way").count() >= 1
    assert made["maintenance"].count() >= 1
    quality.require_fks(made, quality.entity_relations(made))


def test_event_feed_and_its_burst(spark):
    spike = fleet.Spike(start=400, duration=200, kind="both", fraction=0.5)
    made = fleet.events(spark, SIZE, 1000, ts("2024-01-01T00:00"), spike=spike)
    assert made.count() == made.select("event_id").distinct().count() == 1000
    burst = made.filter("is_spike")
    assert 70 < burst.count() < 130
    assert burst.filter("idle_minutes <= 120 or fault_code is null").count() == 0
    calm = made.filter("not is_spike")
    assert calm.agg(F.max("idle_minutes")).first()[0] < 45
    assert calm.filter("fault_code is not null").count() / calm.count() < 0.07
    only_idle = fleet.events(spark, SIZE, 1000, ts("2024-01-01T00:00"), spike=fleet.Spike(400, 200, "idle"))
    assert only_idle.filter("is_spike and idle_minutes <= 120").count() == 0


def test_pipeline_end_to_end_and_again(spark):
    raw = fleet.entities(spark, fleet.Size(sites=6, vehicles=50, customers=40, reservations=200))
    options = {"source_system": "synthetic", "prefix": "t_", "batch_id": "b1", "as_of": ts("2025-01-01T01:00")}
    counts = medallion.run(spark, raw, **options)
    assert len(counts) == 9 + 9 + 2 + 8 + 7
    assert min(counts.values()) > 0
    assert counts["bronze.rentals"] == counts["silver.rentals"] == counts["gold.fact_rental"]
    paid = spark.table("t_silver.payments").agg(F.sum("total_amount_usd")).first()[0]
    for table, column in (
        ("t_gold.fact_rental", "revenue_usd"),
        ("t_gold.kpi_revenue_by_site", "total_revenue_usd"),
        ("t_thin_gold.agg_revenue_by_site_month", "total_revenue_usd"),
    ):
        assert spark.table(table).agg(F.sum(column)).first()[0] == pytest.approx(paid, abs=0.01)
    marks = {t: rows(quality.fingerprint(spark.table(f"t_gold.{t}"))) for t in ("fact_rental", "kpi_one_way_flows")}
    assert medallion.run(spark, raw, rental_buckets=4, **options) == counts
    assert marks == {t: rows(quality.fingerprint(spark.table(f"t_gold.{t}"))) for t in marks}


def test_pipeline_stops_at_broken_references(spark):
    raw = fleet.entities(spark, fleet.Size(sites=3, vehicles=20, customers=10, reservations=30))
    raw["vehicles"] = raw["vehicles"].filter("vehicle_id <> 'V00001'")
    with pytest.raises(quality.QualityError, match="vehicles"):
        medallion.run(spark, raw, source_system="synthetic", prefix="broken_")
    assert not spark.catalog.tableExists("broken_gold.fact_rental")
