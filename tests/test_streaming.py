from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from motorpool.operators import quality
from motorpool.schemas import EVENT
from motorpool.session import configure
from motorpool.sources import events as feed
from motorpool.streaming import jobs, rules
from motorpool.synth import fleet
from tests.conftest import rows, ts

SIZE = fleet.Size(sites=5, vehicles=40, customers=20, reservations=50)
START = ts("2024-06-01T00:00")


@pytest.fixture(scope="module")
def feed_dir(spark, tmp_path_factory):
    """600 events, one every 10 seconds, in four files, with a burst in the middle."""
    path = str(tmp_path_factory.mktemp("feed"))
    made = fleet.events(spark, SIZE, 600, START, 10.0, fleet.Spike.of(600))
    fleet.write_events(made, path, files=4)
    return path


@pytest.fixture(scope="module")
def batch(spark, feed_dir):
    return spark.read.schema(EVENT.schema()).json(feed_dir)


def finish(spark, stream, tmp_path, **options):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    feed.append_flow(stream, out, checkpoint, **options).awaitTermination()
    return feed.read_flow(spark, out)


def test_feed_reads_back_typed(batch):
    assert batch.count() == 600
    assert batch.filter("ts is null or event_id is null").count() == 0
    assert batch.agg(F.max("ts")).first()[0] == ts("2024-06-01T01:39:50")


def test_mapping_text_lines_gives_the_same_events(spark, feed_dir, batch, tmp_path):
    """The way a message queue delivers events: one JSON text per row."""
    lines = spark.readStream.text(feed_dir)
    got = finish(spark, feed.apply_json_mapping(lines, "value", feed.EVENT_MAPPING), tmp_path)
    assert got.columns == batch.columns
    quality.assert_same(batch, got)


def test_replay_takes_one_file_per_batch(spark, feed_dir, tmp_path):
    query = feed.append_flow(feed.replay(spark, feed_dir, 1), str(tmp_path / "o"), str(tmp_path / "c"))
    query.awaitTermination()
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == 4


@pytest.mark.parametrize("alerts", [rules.idle_alerts, rules.fault_alerts, rules.overdue_alerts, rules.evaluate_rules])
def test_alerts_are_the_same_on_stream_and_table(spark, feed_dir, batch, tmp_path, alerts):
    got = finish(spark, alerts(feed.read_events(spark, feed_dir)), tmp_path)
    assert got.count() > 0
    quality.assert_same(alerts(batch), got)


def test_thresholds_are_strict(spark):
    df = spark.createDataFrame(
        [("e1", 120, "", 75000), ("e2", 121, None, 75001), ("e3", None, "P1", None)],
        "event_id string, idle_minutes int, fault_code string, odometer_miles long",
    ).withColumns({"vehicle_id": F.lit("v"), "site_id": F.lit("s"), "ts": F.lit(START)})
    got = rows(rules.evaluate_rules(df), "event_id", "rule", "value")
    assert got == [
        ("e2", "IdleVehicleAlert", "121"),
        ("e2", "MaintenanceOverdueAlert", "75001"),
        ("e3", "MaintenanceFaultAlert", "P1"),
        ("e3", "WorkOrderOnFault", "P1"),
    ]
    assert rows(rules.work_orders(rules.evaluate_rules(df)), "work_order_id", "reason") == [("WorkOrderOnFault:e3", "P1")]


def test_notifications_are_routed_by_site(spark):
    alerts = spark.createDataFrame(
        [
            ("IdleVehicleAlert", "notify", "V1", "e1", "S1", "idle_minutes", "130"),
            ("MaintenanceFaultAlert", "notify", "V2", "e2", "S2", "fault_code", "P0300"),
            ("WorkOrderOnFault", "work_order", "V2", "e2", "S2", "fault_code", "P0300"),
        ],
        "rule string, action string, object_key string, event_id string, site_id string, attribute string, value string",
    ).withColumn("ts", F.lit(START))
    who = spark.createDataFrame([("S1", "north@example.com")], "site_id string, recipient string")
    got = rows(rules.notifications(alerts, who, "office@example.com"), "sent_to", "headline", "reason", "vehicle_id")
    assert got == [
        ("north@example.com", rules.IDLE.headline, "idle_minutes = 130", "V1"),
        ("office@example.com", rules.FAULT.headline, "fault_code = P0300", "V2"),
    ]


def test_landing_stamps_and_partitions_by_day(spark, feed_dir, tmp_path):
    path = str(tmp_path / "landed")
    feed.land_events(feed.read_events(spark, feed_dir), path, str(tmp_path / "c")).awaitTermination()
    landed = feed.read_flow(spark, path)
    assert landed.filter("ingested_at is null").count() == 0
    assert rows(landed.groupBy("event_date").count()) == [(START.date(), 600)]


def test_second_run_takes_only_new_files(spark, feed_dir, tmp_path):
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "c")
    made = fleet.events(spark, SIZE, 20, START)
    fleet.write_events(made.filter("event_id < '8'"), str(source / "a"), files=1)
    stream = lambda: feed.read_events(spark, str(source / "*"))
    feed.append_flow(stream(), out, checkpoint).awaitTermination()
    before = feed.read_flow(spark, out).count()
    fleet.write_events(made.filter("event_id >= '8'"), str(source / "b"), files=1)
    feed.append_flow(stream(), out, checkpoint).awaitTermination()
    assert 0 < before < 20 and feed.read_flow(spark, out).count() == 20
    # A full refresh does not clear the sink: it appends everything again.
    feed.append_flow(stream(), out, str(tmp_path / "fresh")).awaitTermination()
    assert feed.read_flow(spark, out).count() == 40


def test_append_flow_projection(spark, feed_dir, tmp_path):
    got = finish(spark, feed.read_events(spark, feed_dir), tmp_path, projection=["vehicle_id", F.col("ts").alias("at")])
    assert got.columns == ["vehicle_id", "at"]


def test_alert_sink_survives_a_replayed_batch(spark, feed_dir, tmp_path):
    out, checkpoint = tmp_path / "alerts", tmp_path / "c"
    stream = lambda: rules.evaluate_rules(feed.replay(spark, feed_dir, 2))
    jobs.write_alerts(stream(), str(out), str(checkpoint)).awaitTermination()
    first = rows(quality.fingerprint(feed.read_flow(spark, str(out))))
    # Forget that the last batch was committed, as after a crash between store and commit.
    newest = max((checkpoint / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    newest.unlink()
    newest.with_name(f".{newest.name}.crc").unlink()
    jobs.write_alerts(stream(), str(out), str(checkpoint)).awaitTermination()
    stored = feed.read_flow(spark, str(out))
    assert rows(quality.fingerprint(stored)) == first
    assert rows(quality.check_pk(stored, ["rule", "event_id"]), "repeated_keys") == [(0,)]


def test_duplicates_are_stored_once(spark, feed_dir, batch, tmp_path):
    stream = feed.read_events(spark, feed_dir)
    got = finish(spark, jobs.dedup_events(stream.union(stream), "1 day"), tmp_path)
    quality.assert_same(batch, got)


def test_large_state_is_kept_in_rocksdb(spark, feed_dir, batch, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    configure(spark, large_state=True)
    try:
        stream = feed.read_events(spark, feed_dir)
        got = finish(spark, jobs.dedup_events(stream.union(stream), "1 day"), tmp_path)
        quality.assert_same(batch, got)
        assert list((tmp_path / "checkpoint" / "state").rglob("*.zip"))
    finally:
        spark.conf.set(key, before)


def test_windows_close_behind_the_watermark(spark, feed_dir, batch, tmp_path):
    stream = jobs.spike_windows(feed.read_events(spark, feed_dir), "10 minutes", delay="5 minutes")
    got = finish(spark, stream, tmp_path)
    # Events end at 01:39:50, the watermark stands at 01:34:50: windows up to 01:30 are final.
    closed = jobs.spike_windows(batch, "10 minutes").filter(F.col("window_end") <= ts("2024-06-01T01:34:50"))
    assert got.count() == 9
    quality.assert_same(closed, got)


def test_stored_windows_are_complete(spark, feed_dir, batch, tmp_path):
    """Fed file by file, with windows still open at the end: every window is there as it stands."""
    stream = jobs.spike_windows(feed.replay(spark, feed_dir, 1), "10 minutes", delay="2 hours")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    query = feed.upsert_flow(stream, out, checkpoint)
    query.awaitTermination()
    quality.assert_same(jobs.spike_windows(batch, "10 minutes"), feed.read_latest(spark, out, "window_start"))
    assert feed.dropped_late(query) == 0


def test_elevated_windows_show_the_spike(batch):
    calm_or_not = {r.window_start: r.avg_idle for r in jobs.spike_windows(batch, "10 minutes").collect()}
    elevated = {r.window_start for r in jobs.spike_windows(batch, "10 minutes", min_avg_idle=100.0).collect()}
    # The burst covers events 240 to 389, so 00:40 to 01:05.
    assert elevated == {ts("2024-06-01T00:40"), ts("2024-06-01T00:50"), ts("2024-06-01T01:00")}
    assert calm_or_not[ts("2024-06-01T00:00")] < 45


def test_enrichment_resolves_vehicles_and_falls_back(spark, feed_dir, batch, tmp_path):
    vehicles = fleet.vehicles(spark, SIZE).filter("vehicle_id <> 'V00001'")
    sites = fleet.sites(spark, SIZE).filter("site_id <> 'S001'")
    enrich = lambda df: jobs.enrich_events(df, vehicles, sites, (0.5, 0.25))
    got = finish(spark, enrich(feed.read_events(spark, feed_dir)), tmp_path)
    quality.assert_same(enrich(batch), got)
    assert got.count() == 600
    assert rows(got.filter("vehicle_id = 'V00001'").select("vehicle_known", "site_latitude").distinct()) == [(False, 0.5)]
    unknown_site = got.filter("fleet_site_id = 'S001'").select("vehicle_known", "site_longitude").distinct()
    assert rows(unknown_site) == [(True, 0.25)]


def test_curated_telematics(spark, silver, tmp_path):
    path = str(tmp_path / "snapshots")
    snapshots = fleet.telematics(spark, SIZE).withColumn("snapshot_ts", F.to_timestamp("snapshot_ts"))
    snapshots.write.parquet(path)
    stream = feed.stream_table(spark, path, snapshots.schema)
    got = finish(spark, jobs.telematics_curated(stream), tmp_path)
    quality.assert_same(snapshots.select(*jobs.CURATED), got)
