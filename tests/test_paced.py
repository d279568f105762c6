"""The paced feed keeps its rate, and loses or doubles nothing over a restart."""

from __future__ import annotations

import time
from datetime import datetime, timedelta

from motorpool.sources import paced


def test_numbers_follow_the_order(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(f"e{i:04d}", start + timedelta(seconds=i * 37 % 500), i) for i in range(500)]
    events = spark.createDataFrame(rows, "event_id string, ts timestamp, v int").repartition(7)
    got = paced.number_events(events, str(tmp_path / "feed"), files=4)
    found = sorted((r[paced.NUMBER], r.ts, r.event_id) for r in got.collect())
    assert [n for n, *_ in found] == list(range(500)) and [f[1:] for f in found] == sorted((t, i) for i, t, _ in rows)
    assert paced.number_events(events.limit(0), str(tmp_path / "none")).count() == 0


def test_rate_and_restart(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(f"e{i:04d}", start + timedelta(seconds=i)) for i in range(240)]
    numbered = paced.number_events(spark.createDataFrame(rows, "event_id string, ts timestamp"), str(tmp_path / "feed"))
    out, checkpoint, per_second = str(tmp_path / "out"), str(tmp_path / "checkpoint"), 20

    def deliver(df, batch_id):
        df.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    def seen():
        return [r.event_id for r in spark.read.parquet(out).orderBy("event_id").collect()]

    began = time.time()
    query = paced.paced(spark, numbered, per_second, deliver, checkpoint)
    while time.time() - began < 60 and not (tmp_path / "out").exists():
        time.sleep(0.5)
    time.sleep(3)
    query.stop()
    first, spent = seen(), time.time() - began
    assert 0 < len(first) <= per_second * (spent + 1) and len(first) < 240
    assert first == [f"e{i:04d}" for i in range(len(first))] and columns(spark, out) == ["event_id", "ts", "batch"]
    query = paced.paced(spark, numbered, per_second, deliver, checkpoint)
    while time.time() - began < 90 and len(seen()) < 240:
        time.sleep(1)
    query.stop()
    assert seen() == [r[0] for r in rows]


def columns(spark, path):
    return spark.read.parquet(path).columns
