"""The layered batch pipeline: raw -> bronze -> silver -> curated and gold -> aggregates.

``run`` writes every layer; the other functions only describe tables, and nothing runs until
those are read or written.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession

from motorpool.operators import gold, governance, quality, rollups
from motorpool.operators.cleaning import to_silver, with_audit
from motorpool.operators.joins import site_geo
from motorpool.schemas import ENTITIES, SILVER_REFERENCES
from motorpool.sources.tables import overwrite_table, qualified, read_table, write_optimized
from motorpool.streaming.jobs import telematics_curated

Tables = Mapping[str, DataFrame]

# Which tables each table is built from; read by the lineage job and the tests.
GOLD_INPUTS: dict[str, tuple[str, ...]] = {
    "dim_site": ("sites",),
    "dim_vehicle": ("vehicles", "vehicle_classes"),
    "dim_customer": ("customers",),
    "fact_rental": ("rentals", "payments", "sites", "vehicles", "vehicle_classes"),
    "kpi_revenue_by_site": ("fact_rental",),
    "kpi_fleet_utilization": ("fact_rental", "vehicles"),
    "kpi_one_way_flows": ("fact_rental",),
    "kpi_maintenance_cost": ("maintenance", "sites"),
}
CURATED_INPUTS: dict[str, tuple[str, ...]] = {
    "rentals_curated": ("rentals", "sites"),
    "telematics_curated": ("telematics",),
}
AGGREGATE_INPUTS: dict[str, tuple[str, ...]] = {
    "agg_revenue_by_site": ("fact_rental", "dim_site"),
    "agg_revenue_by_site_month": ("fact_rental",),
    "agg_fleet_utilization_by_site_month": ("fact_rental", "dim_vehicle", "dim_site"),
    "agg_idle_vehicles_by_site": ("dim_vehicle", "dim_site"),
    "agg_one_way_flows": ("kpi_one_way_flows", "dim_site"),
    "agg_maintenance_cost_by_site": ("kpi_maintenance_cost", "dim_site"),
    "agg_telematics_freshness": ("telematics_curated",),
}


def pipeline_inputs() -> dict[str, tuple[str, ...]]:
    """Every derived table with the tables it reads, for the lineage job."""
    return {**GOLD_INPUTS, **CURATED_INPUTS, **AGGREGATE_INPUTS}


def dimensions(silver: Tables) -> dict[str, DataFrame]:
    return {
        "dim_site": gold.dim_site(silver["sites"]),
        "dim_vehicle": gold.dim_vehicle(silver["vehicles"], silver["vehicle_classes"]),
        "dim_customer": gold.dim_customer(silver["customers"]),
    }


def fact(silver: Tables, columns: tuple[str, ...] = gold.FACT_RENTAL) -> DataFrame:
    inputs = [silver[n] for n in GOLD_INPUTS["fact_rental"]]
    return gold.fact_rental(*inputs, columns=columns)


def kpis(fact_rental: DataFrame, silver: Tables, unique: bool = False) -> dict[str, DataFrame]:
    """The KPI tables. ``unique`` promises that the fact has one row per rental."""
    return {
        "kpi_revenue_by_site": gold.kpi_revenue_by_site(fact_rental, unique),
        "kpi_fleet_utilization": gold.kpi_fleet_utilization(fact_rental, silver["vehicles"], unique),
        "kpi_one_way_flows": gold.kpi_one_way_flows(fact_rental, unique),
        "kpi_maintenance_cost": gold.kpi_maintenance_cost(silver["maintenance"], silver["sites"]),
    }


def aggregate_tables(
    gold_tables: Tables,
    telematics: DataFrame,
    as_of: datetime | str | Column | None = None,
    unique: bool = False,
) -> dict[str, DataFrame]:
    """The report-ready aggregates.

    ``as_of`` fixes the moment freshness is measured at; ``unique`` is as in :func:`kpis`.
    """
    rentals, vehicles = gold_tables["fact_rental"], gold_tables["dim_vehicle"]
    geo = site_geo(gold_tables["dim_site"])
    return {
        "agg_revenue_by_site": rollups.agg_revenue_by_site(rentals, geo, unique),
        "agg_revenue_by_site_month": rollups.agg_revenue_by_site_month(rentals, unique),
        "agg_fleet_utilization_by_site_month": rollups.agg_fleet_utilization_by_site_month(
            rentals, vehicles, geo, unique=unique
        ),
        "agg_idle_vehicles_by_site": rollups.agg_idle_vehicles_by_site(vehicles, geo),
        "agg_one_way_flows": rollups.agg_one_way_flows(gold_tables["kpi_one_way_flows"], geo),
        "agg_maintenance_cost_by_site": rollups.agg_maintenance_cost_by_site(
            gold_tables["kpi_maintenance_cost"], gold_tables["dim_site"]
        ),
        "agg_telematics_freshness": rollups.agg_telematics_freshness(telematics, as_of),
    }


# How aggregate tables are sorted inside their files, for readers that filter by site or month.
LAYOUT: dict[str, tuple[str, ...]] = {
    "agg_revenue_by_site": ("pickup_site_id",),
    "agg_revenue_by_site_month": ("pickup_site_id", "revenue_month"),
    "agg_fleet_utilization_by_site_month": ("pickup_site_id", "rental_month"),
    "agg_idle_vehicles_by_site": ("current_site_id",),
    "agg_one_way_flows": ("pickup_site_id", "return_site_id"),
    "agg_maintenance_cost_by_site": ("site_id",),
    "agg_telematics_freshness": ("vehicle_id",),
}


def run(
    spark: SparkSession,
    raw: Tables,
    *,
    source_system: str,
    prefix: str = "",
    batch_id: str | None = None,
    as_of: datetime | str | None = None,
    rental_buckets: int = 0,
) -> dict[str, int]:
    """Write all layers as managed tables ``<prefix><layer>.<table>`` and return row counts.

    Each layer is read back from storage by the next, so no step is computed twice, and counts
    come from what was stored. The job stops before gold when a reference does not resolve, and
    after each of the last two layers when a table is empty.

    With ``rental_buckets`` the cleaned rentals are stored in that many buckets by rental id, and
    building the fact joins them to their payments without moving them. Rental ids are unique,
    so buckets are even.
    """
    batch_id = batch_id or str(uuid.uuid4())
    layers = {n: prefix + n for n in ("bronze", "silver", "curated", "gold", "thin_gold")}
    for name in layers.values():
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")

    def name_in(layer: str, table: str) -> str:
        return qualified(layers[layer], table)

    stored: dict[str, DataFrame] = {}

    def write(layer: str, table: str, df: DataFrame, buckets: int = 0) -> DataFrame:
        bucket_by = (buckets, ENTITIES[table].key) if buckets else None
        stored[f"{layer}.{table}"] = overwrite_table(df, name_in(layer, table), bucket_by=bucket_by)
        return stored[f"{layer}.{table}"]

    for table, df in raw.items():
        write("bronze", table, with_audit(df, source_system, "raw", batch_id, as_of))
    silver = {}
    for table in raw:
        cleaned = to_silver(ENTITIES[table], read_table(spark, layers["bronze"], table))
        silver[table] = write("silver", table, cleaned, rental_buckets if table == "rentals" else 0)
    quality.require_fks(silver, SILVER_REFERENCES)

    write("curated", "rentals_curated", gold.rentals_curated(silver["rentals"], silver["sites"]))
    telematics = write("curated", "telematics_curated", telematics_curated(silver["telematics"]))

    # Cleaning leaves one row per key in every table, so the fact has one row per rental.
    golden = {n: write("gold", n, df) for n, df in dimensions(silver).items()}
    golden["fact_rental"] = write("gold", "fact_rental", fact(silver))
    golden |= {n: write("gold", n, df) for n, df in kpis(golden["fact_rental"], silver, unique=True).items()}
    quality.check_non_empty(golden)

    thin = {}
    for table, df in aggregate_tables(golden, telematics, as_of, unique=True).items():
        thin[table] = write_optimized(df, name_in("thin_gold", table), sort_cols=LAYOUT[table])
        stored[f"thin_gold.{table}"] = thin[table]
    quality.check_non_empty(thin)
    return {name: df.count() for name, df in stored.items()}


REGISTRY = "_table_certifications"


def certify_gold(spark: SparkSession, by: str, on: str, prefix: str = "", comment: str = "") -> DataFrame:
    """Mark the gold tables as certified: a registry row and table properties for each.

    Run again to replace the registry and the properties.
    """
    names = [qualified(prefix + "gold", table) for table in GOLD_INPUTS]
    for name in names:
        governance.tag_table(spark, name, by, on, comment=comment)
    return overwrite_table(governance.certify(spark, names, by, on), qualified(prefix + "gold", REGISTRY))
