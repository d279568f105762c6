"""Stored states give what the rows give, at every grouping."""

from __future__ import annotations

import contextlib
import io
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from motorpool.functions import states
from motorpool.operators import rollups
from motorpool.plans import lattice, report
from motorpool.plans.semantic import MEASURES, evaluate, fleet_model, secure
from tests.conftest import rows

CITIES = ["A", "B", None]


@pytest.fixture(scope="module")
def facts(spark):
    """Rentals with nulls everywhere, negative ids, and ids on both sides of a bitmap's border."""
    draw = random.Random(4)
    ids = [-40000, -1, 0, 1, 32768, 32769, 70000, None]
    start = datetime(2024, 1, 1)
    data = [
        (
            i, draw.choice(ids), draw.choice([1, 2, 3, 4, None]), draw.choice([1, 2, 3, 9]), draw.choice([True, False, None]),
            draw.choice([None, 0.005, 10.25, 99.9999, -3.5]), draw.choice([None, 1, 2, 30]), draw.choice([None, 100, 250]),
            start + timedelta(days=draw.randrange(70)), draw.choice(["c1", "c2", "c3", None]),
        )
        for i in range(800)
    ]
    shape = (
        "rental_id long, vehicle_id long, pickup_site_id int, return_site_id int, is_one_way boolean, revenue_usd double,"
        " rental_days int, miles_driven long, pickup_ts timestamp, customer_id string"
    )
    return spark.createDataFrame(data, shape)


@pytest.fixture(scope="module")
def tables(spark, facts):
    sites = spark.createDataFrame(
        [(i, f"s{i}", CITIES[i % 3], "X" if i < 3 else "Y") for i in range(1, 6)], "site_id int, site_name string, city string, state string"
    )
    vehicles = spark.createDataFrame(
        [(v, f"m{v % 3}", 1 + v % 4) for v in (-40000, -1, 0, 1, 32768, 32769)], "vehicle_id long, make string, current_site_id int"
    )
    customers = spark.createDataFrame([("c1", "Gold"), ("c2", None)], "customer_id string, loyalty_tier string")
    return {"fact_rental": facts, "dim_site": sites, "dim_vehicle": vehicles, "dim_customer": customers}


FACT_MEASURES = [n for n, m in MEASURES.items() if {t for t, _ in m.parts} == {"fact_rental"}]
AGGREGATES = [a for n in FACT_MEASURES for _, a in MEASURES[n].parts]


@pytest.fixture(scope="module")
def cuboids(spark, facts, tmp_path_factory):
    def store(df):
        path = str(tmp_path_factory.mktemp("cuboid") / "data")
        df.write.parquet(path)
        return spark.read.parquet(path)

    fine = lattice.build(facts, ["pickup_site_id", "vehicle_id", "customer_id"], AGGREGATES, store)
    site = lattice.build(facts, ["pickup_site_id"], AGGREGATES, store)
    tiny = lattice.coarser(site, [], [a for a in AGGREGATES if not a.distinct], store)
    return [fine, site, tiny]


def answers(df, digits=9):
    return sorted((tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def test_random_questions_agree_with_the_rows(tables, cuboids):
    plain, stored = fleet_model(tables), fleet_model(tables, {"fact_rental": cuboids})
    draw = random.Random(11)
    dims = ["dim_site.state", "dim_site.city", "dim_vehicle.make", "dim_customer.loyalty_tier", "fact_rental.pickup_site_id"]
    slicers = [{}, {"dim_site.state": "X"}, {"dim_vehicle.make": ["m0", "m2"]}, {"dim_site.city": "A", "dim_customer.loyalty_tier": "Gold"}]
    for _ in range(14):
        measures = draw.sample(FACT_MEASURES, draw.randint(1, 4))
        by, filters = draw.sample(dims, draw.randint(0, 2)), draw.choice(slicers)
        assert answers(evaluate(stored, measures, by, filters)) == answers(evaluate(plain, measures, by, filters)), (measures, by, filters)


def test_the_smallest_that_can_answer_is_chosen(cuboids):
    fine, site, tiny = cuboids
    total, seen = states.row_count(), states.distinct("vehicle_id")
    assert lattice.smallest(cuboids, [], [total]) is tiny
    assert lattice.smallest(cuboids, [], [total, seen]) is site
    assert lattice.smallest(cuboids, ["pickup_site_id"], [total, seen]) is site
    assert lattice.smallest(cuboids, ["customer_id"], [seen]) is fine
    assert lattice.smallest(cuboids, ["return_site_id"], [total]) is None
    assert lattice.smallest(cuboids, [], [states.distinct("return_site_id")]) is None
    assert lattice.smallest(cuboids, [], [states.largest("rental_days")]) is None


def test_a_coarser_cuboid_keeps_what_it_can_derive(facts, cuboids):
    keep = lambda df: df
    with pytest.raises(ValueError):
        lattice.coarser(cuboids[1], ["customer_id"], [states.row_count()], keep)
    by_site = lattice.coarser(cuboids[1], ["pickup_site_id"], [states.row_count(), states.distinct("vehicle_id")], keep)
    got = states.merged(by_site.data, ["pickup_site_id"], {"n": states.row_count(), "v": states.distinct("vehicle_id")})
    want = facts.groupBy("pickup_site_id").agg(F.count("*"), F.count_distinct("vehicle_id"))
    assert rows(got) == rows(want)


def test_questions_no_cuboid_answers_read_the_rows(tables, cuboids):
    stored = fleet_model(tables, {"fact_rental": cuboids})
    got = answers(evaluate(stored, ["Total Rentals"], ["fact_rental.return_site_id"]))
    assert got == answers(evaluate(fleet_model(tables), ["Total Rentals"], ["fact_rental.return_site_id"]))


def test_security_cuts_cuboids_too(spark, tables, cuboids):
    mapping = spark.createDataFrame([("ana", "A")], "principal string, city string")
    wanted = ["Total Rentals", "Active Vehicles"]
    for by in ([], ["dim_site.state"], ["dim_vehicle.make"]):
        seen = [secure(fleet_model(tables, c), "dim_site", "city", mapping, "ana") for c in ({}, {"fact_rental": cuboids})]
        assert answers(evaluate(seen[0], wanted, by)) == answers(evaluate(seen[1], wanted, by))
    assert [c.rows for c in seen[1].cuboids["fact_rental"]] == [c.rows for c in cuboids[:2]]


@pytest.mark.parametrize("column", ["vehicle_id", "customer_id", "pickup_site_id"])
def test_drill_with_distinct_values(facts, column):
    levels = ["is_one_way", "return_site_id"]
    measures = {"n": states.row_count(), "usd": states.usd("revenue_usd"), "seen": states.distinct(column), "days": states.mean("rental_days")}
    got = rollups.drill(facts, levels, measures)
    depth = (F.lit(2) - F.bit_count(F.grouping_id())).cast("int").alias("depth")
    want = facts.rollup(*levels).agg(depth, *[a().alias(n) for n, a in measures.items()])
    assert answers(got) == answers(want)
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        got.explain()
    plan = shown.getvalue()
    # Rows below are grouped before they are multiplied by the levels.
    assert "HashAggregate" in plan[plan.index("Expand") :]


def test_drill_of_measures_and_of_two_ids(tables):
    model = fleet_model(tables)
    opened = report.hierarchy(model, "fact_rental", ["dim_site.state", "dim_site.city"], "Active Vehicles")
    assert {r.depth for r in opened.collect()} == {0, 1, 2}
    with pytest.raises(ValueError):
        rollups.drill(tables["fact_rental"], ["is_one_way"], {"a": states.distinct("vehicle_id"), "b": states.distinct("customer_id")})


def test_no_rows(facts):
    none = facts.limit(0)
    measures = {"n": states.row_count(), "v": states.distinct("vehicle_id")}
    assert rollups.drill(none, ["is_one_way"], measures).count() == 0
    assert states.merged(states.partial(none, ["is_one_way"], list(measures.values())), ["is_one_way"], measures).count() == 0


def test_extremes_cannot_be_taken_back(facts):
    with pytest.raises(ValueError):
        states.signed(facts, ["is_one_way"], [states.largest("rental_days")], F.lit(1))
