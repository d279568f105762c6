from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motorpool.__main__ import main
from motorpool.operators import governance, quality
from motorpool.operators.cleaning import to_silver
from motorpool.plans import generate
from motorpool.schemas import EVENT, RENTALS
from motorpool.sources import tables
from motorpool.sources.events import read_flow
from motorpool.streaming.watch import watch
from tests.conftest import rows

SMALL = ["--sites", "4", "--vehicles", "30", "--customers", "20", "--reservations", "80"]


def test_generate_then_pipeline(spark, tmp_path, capsys):
    out = str(tmp_path / "fleet")
    main(["generate", "--out", out, *SMALL])
    listed = {r.entity: r for r in spark.read.json(f"{out}/manifest").collect()}
    assert len(listed) == 9
    assert listed["vehicles"].rows == 30 and listed["vehicles"].seed == 42
    assert listed["rentals"].history_end == "2025-01-01" and listed["rentals"].one_way_rentals > 0
    for name, df in generate.read_fleet(spark, out, "csv").items():
        quality.assert_same(df, generate.read_fleet(spark, out)[name])
    main(["pipeline", "--raw", out, "--format", "csv", "--prefix", "cli_"])
    assert "thin_gold.agg_revenue_by_site" in capsys.readouterr().out
    assert spark.table("cli_gold.dim_vehicle").count() == 30
    for _ in range(2):
        main(["certify", "--by", "data team", "--date", "2025-01-01", "--prefix", "cli_"])
    registry = spark.table("cli_gold._table_certifications")
    assert registry.count() == 8 and registry.filter("certification_status <> 'CERTIFIED'").count() == 0
    assert governance.table_tags(spark, "cli_gold.fact_rental").count() == 4


def test_files_written_by_another_tool(spark, tmp_path):
    """Whole numbers with gaps arrive as floats, missing text as an empty field."""
    frame = pd.DataFrame(
        {
            "rental_id": ["RN1", "RN2"],
            "reservation_id": ["R1", None],
            "customer_id": ["C1", "C2"],
            "vehicle_id": ["V1", "V2"],
            "vehicle_class_id": ["VC1", "VC1"],
            "pickup_site_id": ["S1", "S1"],
            "return_site_id": ["S1", "S2"],
            "pickup_ts": ["2024-01-01T10:00:00Z", "2024-01-02T10:00:00Z"],
            "planned_return_ts": ["2024-01-03T10:00:00Z", "2024-01-04T10:00:00Z"],
            "return_ts": ["2024-01-03T11:00:00Z", None],
            "odometer_out": [2500, 2600],
            "odometer_in": [2700.0, float("nan")],
            "miles_driven": [200.0, float("nan")],
            "is_one_way": [False, True],
            "status": ["closed", "open"],
        }
    )
    frame.to_csv(tmp_path / "rentals.csv", index=False)
    frame.to_parquet(tmp_path / "rentals.parquet", index=False)
    for fmt in ("csv", "parquet"):
        raw = generate.read_raw(spark, str(tmp_path), RENTALS, fmt)
        assert raw.schema == RENTALS.raw_schema()
        clean = to_silver(RENTALS, raw)
        got = rows(clean, "rental_id", "reservation_id", "odometer_in", "miles_driven", "is_one_way", "rental_days")
        assert got == [("RN1", "R1", 2700, 200, False, 2), ("RN2", None, None, None, True, None)]


def test_feed_then_watch(spark, tmp_path):
    feed, out, state = str(tmp_path / "feed"), str(tmp_path / "out"), str(tmp_path / "state")
    main(["events", "--out", feed, "--count", "400", "--inject-spike", "--spike-type", "idle", "--files", "3", *SMALL])
    main(["watch", "--events", feed, "--out", out, "--checkpoint", state])
    events = spark.read.schema(EVENT.schema()).json(feed)
    seen = watch(spark, feed, out, state)
    assert seen.events.count() == 400
    spikes = events.filter("is_spike")
    assert spikes.count() > 20
    raised = seen.alerts.filter("rule = 'IdleVehicleAlert'")
    assert rows(raised, "event_id") == rows(spikes, "event_id")
    faults = events.filter("fault_code is not null")
    assert rows(seen.work_orders, "vehicle_id") == rows(faults, "vehicle_id")
    assert read_flow(spark, f"{out}/alerts").count() == seen.alerts.count()


def test_event_table_grows_but_never_changes(spark):
    first = T.StructType(EVENT.schema().fields[:3])
    assert tables.add_missing_columns(spark, "grown", first) == first.names
    spark.createDataFrame([("e", "v", "s")], first).write.insertInto("grown")
    added = tables.add_missing_columns(spark, "grown", EVENT.schema())
    assert added == EVENT.schema().names[3:]
    assert tables.add_missing_columns(spark, "grown", EVENT.schema()) == []
    assert rows(spark.table("grown"), "event_id", "idle_minutes") == [("e", None)]
    with pytest.raises(ValueError, match="event_id"):
        tables.add_missing_columns(spark, "grown", T.StructType([T.StructField("event_id", T.LongType())]))
    tables.describe_columns(spark, "grown", {"ts": "Event time, it's UTC", "site_id": "Nearest site"})
    notes = dict(rows(spark.sql("DESCRIBE TABLE grown").filter(F.col("comment").isNotNull()), "col_name", "comment"))
    assert notes == {"ts": "Event time, it's UTC", "site_id": "Nearest site"}
