from __future__ import annotations

from pyspark.sql import functions as F

from motorpool.operators import filters, graph, joins
from tests.conftest import rows, ts


def _graph(silver):
    return graph.fleet_graph(silver["vehicles"], silver["sites"], silver["rentals"])


def test_idle_vehicles_agree_with_the_aggregate(silver, golden):
    asked = rows(graph.idle_vehicles_by_site(_graph(silver)))
    assert asked == [("North", 1)]
    assert asked == rows(golden["agg_idle_vehicles_by_site"].filter("idle_vehicles > 0"), "site_name", "idle_vehicles")


def test_one_way_paths(silver):
    assert rows(graph.one_way_paths(_graph(silver))) == [("North", "South", 1), ("South", "North", 1)]


def test_vehicles_at_a_named_site(silver):
    assert rows(graph.vehicles_at(_graph(silver), "South")) == [("x2", "m", "b", "maintenance"), ("x3", "n", "c", "rented")]
    assert rows(graph.vehicles_at(_graph(silver), "Nowhere")) == []


def test_edges_leave_out_missing_ends(silver):
    g = _graph(silver)
    assert rows(g.edges("located_at")) == [("V1", "S1"), ("V2", "S2"), ("V3", "S2"), ("V4", "S1")]
    assert rows(g.edges("returned_at"), "src") == rows(silver["rentals"].filter("return_site_id is not null"), "rental_id")


def test_sites_of_one_name_are_counted_together(silver):
    sites = silver["sites"].withColumn("site_name", F.lit("Same"))
    g = graph.fleet_graph(silver["vehicles"], sites, silver["rentals"])
    assert rows(graph.one_way_paths(g)) == [("Same", "Same", 2)]


def test_orphans_and_their_complement(silver):
    lost = joins.orphans(silver["rentals"], "vehicle_id", silver["vehicles"], "vehicle_id")
    assert rows(lost, "rental_id") == [("R6",)]
    kept = silver["rentals"].join(silver["vehicles"], "vehicle_id", "left_semi")
    assert kept.count() + lost.count() == silver["rentals"].count()


def test_fk_counts(spark):
    child = spark.createDataFrame([(1, "a"), (2, "a"), (3, "z"), (4, None)], "n int, k string")
    parent = spark.createDataFrame([("a",), ("a",), ("b",)], "p string")
    assert rows(joins.fk_resolves(child, "k", parent, "p")) == [(4, 2, 1, 1)]
    assert rows(joins.orphan_keys(child, "k", parent, "p")) == [("z", 1)]


def test_lookup_with_spread_nulls_is_a_left_join(spark):
    fact = spark.range(200).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("k"))
    dim = spark.createDataFrame([(i, f"n{i}") for i in range(5)], "k long, name string")
    assert rows(joins.lookup(fact, dim, "k", spread_nulls_by="id")) == rows(joins.lookup(fact, dim, "k"))


def test_filters(spark):
    df = spark.createDataFrame(
        [(1, ts("2024-01-01T00:00"), 120, True), (2, ts("2024-01-08T00:00"), 121, False), (3, None, None, None)],
        "id int, ts timestamp, idle int, is_one_way boolean",
    )
    assert rows(filters.threshold(df, "idle", ">", 120), "id") == [(2,)]
    assert rows(filters.one_way(df), "id") == [(1,)]
    assert rows(filters.in_range(df, "ts", ts("2024-01-01T00:00"), ts("2024-01-08T00:00")), "id") == [(1,), (2,)]
    assert rows(filters.retain(df, "ts", 7, ts("2024-01-08T00:00")), "id") == [(1,), (2,)]
    assert rows(filters.hot_set(df, "ts", ts("2024-01-08T00:01")), "id") == [(2,)]
    assert rows(filters.new_since(df, "ts", ts("2024-01-01T00:00")), "id") == [(2,)]
