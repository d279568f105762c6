"""The curated layer as declarations for Spark's own pipeline runner.

The same functions as elsewhere, registered as a materialized view, a streaming table and a
sink fed by an append flow. Call :func:`declare_curated` from a pipeline source file that
``spark-pipelines run`` picks up; outside a pipeline nothing here has to be imported.
"""

from __future__ import annotations

from pyspark import pipelines as dp
from pyspark.sql import DataFrame, SparkSession

from motorpool.operators import gold
from motorpool.sources.tables import qualified
from motorpool.streaming import jobs

PROPERTIES = {"quality": "curated"}

# The columns of the external rentals table; it has no site city.
EXTERNAL_COLUMNS = (
    "rental_id",
    "vehicle_id",
    "customer_id",
    "pickup_site_id",
    "return_site_id",
    "pickup_ts",
    "return_ts",
    "miles_driven",
    "rental_days",
    "is_one_way",
    "status",
)


def declare_curated(
    spark: SparkSession,
    silver: str = "silver",
    external_path: str | None = None,
    external_format: str = "parquet",
) -> None:
    """Declare ``rentals_curated``, ``telematics_curated`` and, given a path, the external sink."""

    @dp.materialized_view(
        name="rentals_curated",
        comment="Rentals with the city of their pickup site, the column row filters go by.",
        table_properties=PROPERTIES,
    )
    def rentals_curated() -> DataFrame:
        return gold.rentals_curated(
            spark.read.table(qualified(silver, "rentals")), spark.read.table(qualified(silver, "sites"))
        )

    @dp.table(
        name="telematics_curated",
        comment="Vehicle telemetry, read as it is appended.",
        table_properties=PROPERTIES,
    )
    def telematics_curated() -> DataFrame:
        return jobs.telematics_curated(spark.readStream.table(qualified(silver, "telematics")))

    if external_path is None:
        return
    dp.create_sink("rentals_external", external_format, {"path": external_path})

    @dp.append_flow(target="rentals_external", name="rentals_external_flow")
    def rentals_external_flow() -> DataFrame:
        return spark.readStream.table(qualified(silver, "rentals")).select(*EXTERNAL_COLUMNS)
