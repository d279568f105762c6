"""Entity-relationship questions over vehicles, sites and rentals.

Every relationship here leads from one node to at most one other, so an edge is a key column of
its source node. A pattern that follows two edges of the same node reads both columns of one
row, and only the reduced result meets the site names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorpool.operators.joins import role_dim

# Edge type -> (source node, key column of the source that names the site).
EDGES = {
    "located_at": ("vehicle", "current_site_id"),
    "picked_up_at": ("rental", "pickup_site_id"),
    "returned_at": ("rental", "return_site_id"),
}


@dataclass(frozen=True)
class FleetGraph:
    """Node tables; each has its own key and the key columns of the edges that leave it."""

    vehicle: DataFrame
    site: DataFrame
    rental: DataFrame

    def edges(self, kind: str) -> DataFrame:
        """The edges of one type as ``src`` and ``dst`` keys."""
        node, column = EDGES[kind]
        table = getattr(self, node)
        return role_dim(table, {f"{node}_id": "src", column: "dst"}).dropna()

    def named(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """Replace a site key by the site's name; rows without a site drop out."""
        return df.join(role_dim(self.site, {"site_id": column, "site_name": name}), column).drop(column)


def fleet_graph(vehicles: DataFrame, sites: DataFrame, rentals: DataFrame) -> FleetGraph:
    return FleetGraph(vehicle=vehicles, site=sites, rental=rentals)


def idle_vehicles_by_site(graph: FleetGraph, status: str = "idle") -> DataFrame:
    """Vehicles of one status per site name, most first."""
    at_site = graph.vehicle.filter(F.col("status") == status).groupBy("current_site_id").agg(F.count("*").alias("_n"))
    named = graph.named(at_site, "current_site_id", "site_name")
    totals = named.groupBy("site_name").agg(F.sum("_n").alias("idle_vehicles"))
    return totals.orderBy(F.col("idle_vehicles").desc(), "site_name")


def one_way_paths(graph: FleetGraph) -> DataFrame:
    """Trips between two different sites by name: pickup <- rental -> return, most first."""
    pairs = (
        graph.rental.filter(F.col("pickup_site_id") != F.col("return_site_id"))
        .groupBy("pickup_site_id", "return_site_id")
        .agg(F.count("*").alias("_n"))
    )
    named = graph.named(graph.named(pairs, "pickup_site_id", "pickup_site"), "return_site_id", "return_site")
    trips = named.groupBy("pickup_site", "return_site").agg(F.sum("_n").alias("trips"))
    return trips.orderBy(F.col("trips").desc(), "pickup_site", "return_site")


def vehicles_at(graph: FleetGraph, site_name: str) -> DataFrame:
    """Vehicles located at the named site."""
    here = graph.site.filter(F.col("site_name") == site_name).select(F.col("site_id").alias("current_site_id"))
    return graph.vehicle.join(here, "current_site_id", "left_semi").select("vin", "make", "model", "status")
