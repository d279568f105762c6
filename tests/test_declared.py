"""Declarations are recorded by a registry of our own; no pipeline server is started."""

from __future__ import annotations

import pytest
from pyspark.pipelines.graph_element_registry import GraphElementRegistry, graph_element_registration_context

from motorpool.operators import gold, quality
from motorpool.plans.declared import EXTERNAL_COLUMNS, declare_curated
from motorpool.streaming import jobs


class Recorder(GraphElementRegistry):
    def __init__(self):
        self.outputs, self.flows = {}, {}

    def register_output(self, output):
        self.outputs[output.name] = type(output).__name__

    def register_flow(self, flow):
        self.flows[flow.name] = flow

    def register_sql(self, sql_text, file_path):
        raise AssertionError("no SQL is declared")


@pytest.fixture(scope="module")
def declared(spark, silver):
    spark.sql("CREATE DATABASE IF NOT EXISTS declared_silver")
    for name in ("rentals", "sites"):
        silver[name].write.mode("overwrite").saveAsTable(f"declared_silver.{name}")
    extra = silver["telematics"].selectExpr("*", "0.5D latitude", "0.25D longitude", "50 fuel_or_soc_pct")
    extra.write.mode("overwrite").saveAsTable("declared_silver.telematics")
    recorder = Recorder()
    with graph_element_registration_context(recorder):
        declare_curated(spark, "declared_silver", "/tmp/never-written")
    return recorder


def test_what_is_declared(declared):
    assert declared.outputs == {
        "rentals_curated": "MaterializedView",
        "telematics_curated": "StreamingTable",
        "rentals_external": "Sink",
    }
    assert set(declared.flows) == {"rentals_curated", "telematics_curated", "rentals_external_flow"}
    assert declared.flows["rentals_external_flow"].target == "rentals_external"


def test_the_view_is_the_operator(declared, silver):
    quality.assert_same(
        declared.flows["rentals_curated"].func(), gold.rentals_curated(silver["rentals"], silver["sites"])
    )


def test_streams_are_streams(declared):
    telemetry = declared.flows["telematics_curated"].func()
    assert telemetry.isStreaming and telemetry.columns == list(jobs.CURATED)
    external = declared.flows["rentals_external_flow"].func()
    assert external.isStreaming and external.columns == list(EXTERNAL_COLUMNS)
