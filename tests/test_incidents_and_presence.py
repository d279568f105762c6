"""Incidents and presence: the same rows in a batch and on a stream, however it is cut and restarted."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from motorpool.sources import events as feed
from motorpool.streaming import incidents as runs
from motorpool.streaming import presence
from tests.conftest import rows

START = datetime(2024, 6, 1)
SHAPE = "event_id string, vehicle_id string, ts timestamp, idle_minutes int, fault_code string, odometer_miles long"


def made(n=400, seed=3):
    """Events in the order of time, seconds apart, with pauses, equal times and readings without a vehicle."""
    draw, at, found = random.Random(seed), START, []
    for i in range(n):
        at += timedelta(seconds=draw.choice([0, 7, 40, 90, 1500 if draw.random() < 0.1 else 20]), microseconds=draw.randrange(1000))
        vehicle = draw.choice(["v1", "v1", "v1", "v2", "v3", None])
        found.append((f"e{i}", vehicle, at, draw.choice([None, 5, 121, 200]), draw.choice([None, "", "", "P1"]), draw.choice([None, i * 3])))
    return found


@pytest.fixture(scope="module")
def parts():
    """Eight slices of time; rows of a slice are in no order."""
    events, draw = made(), random.Random(1)
    slices = [events[i : i + 50] for i in range(0, len(events), 50)]
    for s in slices:
        draw.shuffle(s)
    return slices


def run(spark, parts, tmp_path, build, groups):
    """Feed the slices group by group: a restart before each group, micro-batches of one file inside it."""
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    number = 0
    for group in groups:
        for _ in range(group):
            spark.createDataFrame(parts[number], SHAPE).coalesce(1).write.parquet(f"{source}/part={number}")
            number += 1
        stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
        feed.append_flow(build(stream), out, checkpoint).awaitTermination()
    return feed.read_flow(spark, out)


def plain_incidents(events, gap, limit=120):
    found = []
    for vehicle in {e[1] for e in events}:
        hot = sorted((e for e in events if e[1] == vehicle and ((e[3] or 0) > limit or e[4])), key=lambda e: e[2])
        for e in hot:
            if found and found[-1][0] == vehicle and e[2] - found[-1][2] < gap:
                found[-1][2:] = [e[2], found[-1][3] + 1, max(found[-1][4], e[3] or -1), found[-1][5] + bool(e[4])]
            else:
                found.append([vehicle, e[2], e[2], 1, -1 if e[3] is None else e[3], int(bool(e[4]))])
    return sorted(((v, a, b, n, None if p < 0 else p, k) for v, a, b, n, p, k in found), key=repr)


COLUMNS = ("vehicle_id", "begin_ts", "end_ts", "readings", "peak_idle_minutes", "faults")


@pytest.mark.parametrize("minutes", [1, 3, 20])
def test_incidents_of_a_table(spark, parts, minutes):
    events = [e for p in parts for e in p]
    df = spark.createDataFrame([*events, ("none", "v1", None, 500, "P9", 1)], SHAPE)
    assert rows(runs.incidents(df, minutes), *COLUMNS) == plain_incidents(events, timedelta(minutes=minutes))
    assert runs.incidents(df.limit(0), minutes).count() == 0


@pytest.mark.parametrize("groups", [[8], [1, 4, 3]])
def test_incidents_of_a_stream(spark, parts, tmp_path, groups):
    got = run(spark, parts, tmp_path, lambda s: runs.stream_incidents(s, 3, "2 minutes"), groups)
    events = [e for p in parts for e in p]
    gap, mark = timedelta(minutes=3), max(e[2] for e in events)
    mark = mark.replace(microsecond=mark.microsecond // 1000 * 1000) - timedelta(minutes=2)
    assert rows(got, *COLUMNS) == [i for i in plain_incidents(events, gap) if i[2] + gap <= mark]


def plain_presence(events, silence, delay):
    known = [e for e in events if e[1] is not None]
    mark = max(e[2] for e in known)
    mark = mark.replace(microsecond=mark.microsecond // 1000 * 1000) - delay
    found = []
    for vehicle in {e[1] for e in known}:
        own = sorted((e for e in known if e[1] == vehicle), key=lambda e: (e[2], e[0]))
        for i, e in enumerate(own):
            if e[2] > mark:
                break
            before = own[i - 1][5] if i else None
            change = e[5] - before if e[5] is not None and before is not None else None
            found.append((vehicle, "reading", e[0], e[2], e[5], before, change))
            until = min(own[i + 1][2], mark) if i + 1 < len(own) else mark
            if until - e[2] > silence:
                found.append((vehicle, "silent", None, e[2] + silence, e[5], None, None))
    return sorted(found, key=repr)


@pytest.mark.parametrize("groups", [[8], [2, 1, 5]])
def test_presence(spark, parts, tmp_path, groups):
    got = run(spark, parts, tmp_path, lambda s: presence.presence(s, 5, "2 minutes"), groups)
    want = plain_presence([e for p in parts for e in p], timedelta(minutes=5), timedelta(minutes=2))
    assert rows(got) == want
    assert sum(r[1] == "silent" for r in want) > 10
