from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from motorpool.operators import quality
from motorpool.schemas import EVENT, RENTALS, SITES
from motorpool.sources import events, tables
from motorpool.synth import fleet
from tests.conftest import rows, ts


def test_names_skip_empty_parts():
    assert tables.qualified("", "gold", "dim_site") == "gold.dim_site"


def test_entity_files_round_trip(spark, tmp_path):
    size = fleet.Size(sites=5, vehicles=30, customers=20, reservations=60)
    raw = fleet.rentals(spark, size)
    tables.write_entity(raw, str(tmp_path), "rentals")
    for fmt in ("csv", "parquet"):
        back = tables.read_entity(spark, str(tmp_path), "rentals", RENTALS.raw_schema(), fmt)
        quality.assert_same(raw, back)


def test_empty_text_and_null_stay_apart_in_csv(spark, tmp_path):
    df = spark.createDataFrame([("a", ""), ("b", None), ("c", "x")], "k string, v string")
    tables.write_entity(df, str(tmp_path), "t", "csv")
    assert rows(tables.read_entity(spark, str(tmp_path), "t", df.schema, "csv")) == rows(df)


def test_overwrite_is_idempotent_and_may_change_the_schema(spark, silver):
    first = rows(quality.fingerprint(tables.overwrite_table(silver["sites"], "over_sites")))
    again = rows(quality.fingerprint(tables.overwrite_table(silver["sites"], "over_sites")))
    assert first == again
    wider = tables.overwrite_table(silver["sites"].withColumn("extra", F.lit(1)), "over_sites")
    assert "extra" in wider.columns
    assert tables.read_table(spark, "", "default", "over_sites").count() == 3


def test_external_table(spark, silver, tmp_path):
    path = str(tmp_path / "sites")
    silver["sites"].write.parquet(path)
    assert tables.read_external(spark, path, SITES.schema()).count() == 3
    tables.register_external(spark, "external_sites", path)
    assert tables.table_location(spark, "external_sites").endswith("/sites")
    assert rows(spark.table("external_sites")) == rows(silver["sites"])
    spark.sql("DROP TABLE external_sites")
    assert spark.read.parquet(path).count() == 3


def test_optimised_write(spark):
    df = spark.range(10_000).select("id", (F.col("id") % 7).alias("site"))
    stored = tables.write_optimized(
        df, "compact", sort_cols=["site"], target_rows=4_000, properties={"layout": "sorted"}
    )
    assert stored.count() == 10_000
    assert len(stored.inputFiles()) == 3
    assert spark.sql("SHOW TBLPROPERTIES compact").filter("key = 'layout'").count() == 1
    one_file = spark.read.parquet(stored.inputFiles()[0])
    values = [r.site for r in one_file.collect()]
    assert values == sorted(values)


def test_rows_of_a_day_that_come_later_join_it(spark, tmp_path):
    path = str(tmp_path / "events")
    df = spark.createDataFrame([(1, ts("2024-01-01T05:00")), (2, ts("2024-01-02T05:00"))], "id int, ts timestamp")
    tables.write_by_day(df, path, "ts")
    tables.write_by_day(df.filter("id = 2").withColumn("id", F.lit(9)), path, "ts")
    assert rows(spark.read.parquet(path), "id") == [(1,), (2,), (9,)]


def test_days_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "events")
    df = spark.createDataFrame(
        [(1, ts("2024-01-01T05:00")), (2, ts("2024-01-02T05:00"))], "id int, ts timestamp"
    )
    tables.replace_days(df, path, "ts")
    tables.replace_days(df.filter("id = 2").withColumn("id", F.lit(9)), path, "ts")
    assert rows(spark.read.parquet(path), "id") == [(1,), (9,)]
    plan = spark.read.parquet(path).filter("event_date = date'2024-01-02'")
    assert len(plan.inputFiles()) >= 1
    assert "PartitionFilters: [isnotnull(event_date" in plan._jdf.queryExecution().executedPlan().toString()


def test_old_days_expire_as_whole_partitions(spark):
    df = spark.createDataFrame([(i, date(2024, 1, i)) for i in range(1, 11)], "id int, event_date date")
    df.write.mode("overwrite").partitionBy("event_date").saveAsTable("daily_events")
    gone = tables.expire_days(spark, "daily_events", 3, date(2024, 1, 10))
    assert gone == [date(2024, 1, i) for i in range(1, 7)]
    assert rows(spark.table("daily_events"), "id") == [(10,), (7,), (8,), (9,)]
    assert tables.expire_days(spark, "daily_events", 3, date(2024, 1, 10)) == []


def test_old_days_of_landed_events_expire(spark, tmp_path):
    """Landed files lie under flow, batch and day."""
    from motorpool.sources import events as feed

    source = str(tmp_path / "source")
    old_and_new = [(1, ts("2020-05-05T05:00")), (2, ts("2024-01-09T05:00"))]
    spark.createDataFrame(old_and_new, "event_id int, ts timestamp").write.parquet(source)
    stream = feed.stream_table(spark, source, "event_id int, ts timestamp")
    feed.land_events(stream, out := str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    tables.register_external(spark, "landed_feed", out)
    spark.sql("MSCK REPAIR TABLE landed_feed")
    assert tables.expire_days(spark, "landed_feed", 30, date(2024, 1, 10)) == [date(2020, 5, 5)]
    assert rows(spark.table("landed_feed"), "event_id") == [(2,)]
    spark.sql("DROP TABLE landed_feed")


def test_manifest(silver):
    got = {r.entity: (r.rows, r.columns) for r in tables.manifest(silver).collect()}
    assert got["sites"][0] == 3 and got["sites"][1].startswith("site_id,site_code")
    assert len(got) == 8


def test_json_mapping_types_and_bad_values(spark):
    df = spark.createDataFrame(
        [
            ('{"event_id":"e1","ts":"2024-01-01T00:00:00Z","idle_minutes":5,"is_spike":true,"speed_mph":"fast"}',),
            ("not json",),
        ],
        "body string",
    )
    got = events.apply_json_mapping(df, "body", events.EVENT_MAPPING)
    assert got.columns == list(EVENT.columns)
    assert dict(got.dtypes) == {f.name: f.dataType.simpleString() for f in EVENT.schema()}
    assert rows(got, "event_id", "ts", "idle_minutes", "is_spike", "speed_mph") == [
        ("e1", ts("2024-01-01T00:00"), 5, True, None),
        (None, None, None, None, None),
    ]
