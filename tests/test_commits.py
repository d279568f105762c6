"""Committed tables: snapshots, compaction, expiry, and aggregates kept up batch by batch."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from motorpool.plans import thin_gold
from motorpool.sources import commits
from motorpool.sources.commits import CommittedTable, ConflictError, first_fit_decreasing
from tests.conftest import rows

DAY = datetime(2024, 1, 1)


@pytest.fixture
def table(spark, tmp_path):
    return CommittedTable(spark, str(tmp_path / "t"), {"events": "id long, ts timestamp_ntz, v int"}, {"events": "ts"})


def events(spark, low, high, parts=3):
    data = [(i, DAY + timedelta(hours=i), i % 7) for i in range(low, high)]
    return spark.createDataFrame(data, "id long, ts timestamp_ntz, v int").repartition(parts)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_first_fit_decreasing():
    bins = first_fit_decreasing([5, 4, 3, 3, 2, 2, 1, 20], 10)
    assert bins == [[7], [0, 1, 6], [2, 3, 4, 5]] and first_fit_decreasing([], 10) == []
    draw = random.Random(1)
    sizes = [draw.randrange(1, 60) for _ in range(200)]
    bins = first_fit_decreasing(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(200)) and all(sum(sizes[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= 11 / 9 * -(-sum(sizes) // 100) + 1


def test_append_replay_and_snapshots(spark, table):
    assert table.read("events").count() == 0 and table.snapshot().version == -1
    assert table.append({"events": events(spark, 0, 50)}, "feed", 0)
    assert not table.append({"events": events(spark, 0, 50)}, "feed", 0)
    first = table.read("events")
    assert table.append({"events": events(spark, 50, 80)}, "feed", 1)
    assert table.append({"events": events(spark, 80, 90)}, "other", 0)
    assert not table.append({"events": events(spark, 0, 9)}, "feed", 1)
    assert ids(first) == ids(table.read("events", version=0)) == list(range(50))
    assert ids(table.read("events")) == list(range(90))
    assert table.snapshot().batches == {"feed": 1, "other": 0}
    assert sum(f.rows for f in table.snapshot().files) == 90


def test_files_out_of_range_are_not_opened(spark, table):
    for n in range(4):
        table.append({"events": events(spark, 24 * n, 24 * n + 24, 1)}, "feed", n)
    got = table.read("events", low="2024-01-02 00:00:00", high="2024-01-02 11:00:00")
    assert ids(got) == list(range(24, 36)) and len(got.inputFiles()) == 1


def test_compaction_leaves_readers_their_snapshot(spark, table):
    for n in range(6):
        table.append({"events": events(spark, 10 * n, 10 * n + 10)}, "feed", n)
    before = table.read("events")
    many = len(table.snapshot().files)
    largest = max(f.size for f in table.snapshot().files)
    assert table.compact("events", 5 * largest) == many
    after = table.snapshot().of("events")
    assert len(after) < many / 2 and all(f.size <= 6 * largest for f in after)
    assert ids(before) == ids(table.read("events")) == list(range(60))
    assert table.read("events").columns == ["id", "ts", "v"] and sum(f.rows for f in after) == 60
    assert table.vacuum(keep=1) == many and ids(table.read("events")) == list(range(60))
    assert len(table.versions()) == 1


def test_expiry_goes_through_the_log(spark, table):
    for n in range(3):
        table.append({"events": events(spark, 24 * n, 24 * n + 24)}, "feed", n)
    before = table.read("events")
    assert table.expire("events", "2024-01-02 00:00:00") > 0
    assert ids(table.read("events")) == list(range(24, 72)) and ids(before) == list(range(72))
    assert table.expire("events", "2024-01-02 00:00:00") == 0


def test_the_slower_writer_starts_over(spark, table, monkeypatch):
    table.append({"events": events(spark, 0, 5)}, "feed", 0)
    files = table.write("events", events(spark, 5, 9))
    seen = table.snapshot()
    table.append({"events": events(spark, 20, 22)}, "other", 0)
    with monkeypatch.context() as m:
        answers = [seen]  # what it read before the other came
        real = CommittedTable.snapshot
        m.setattr(CommittedTable, "snapshot", lambda self, version=None: answers.pop() if answers else real(self, version))
        assert table.admit(files, "feed", 1)
    assert ids(table.read("events")) == [*range(9), 20, 21]
    with pytest.raises(ConflictError):
        table.admit([], "feed", 7, on=seen.version)
    old = real(table, 0).of("events")
    table.swap("events", old, [])
    with pytest.raises(ConflictError):
        table.swap("events", old, [])
    monkeypatch.setattr(commits, "ATTEMPTS", 0)
    with pytest.raises(ConflictError):
        table.append({"events": events(spark, 0, 1)}, "feed", 9)


def test_a_job_that_died_before_its_commit_changes_nothing(spark, table):
    table.append({"events": events(spark, 0, 5)}, "feed", 0)
    table.write("events", events(spark, 5, 9))
    assert ids(table.read("events")) == list(range(5))
    assert table.append({"events": events(spark, 5, 9)}, "feed", 1) and table.vacuum() > 0
    assert ids(table.read("events")) == list(range(9))


# --- aggregates kept up -----------------------------------------------------------------------

FACT = "rental_id string, pickup_site_id string, return_site_id string, is_one_way boolean, pickup_ts timestamp, revenue_usd double, rental_days int"


def rentals(draw, names):
    return [
        (
            n, draw.choice(["S1", "S2", None]), draw.choice(["S1", "S2", "S3"]), draw.choice([True, False]), DAY + timedelta(days=draw.randrange(70)),
            draw.choice([None, 0.005, 12.34, 99.9999]), draw.choice([None, 1, 5]), draw.random() < 0.15,
        )
        for n in names
    ]


def rebuilt(spark, current, sites, vehicles):
    fact = spark.createDataFrame([r[:7] for r in current.values() if not r[7]], FACT)
    return thin_gold.tables(thin_gold.rental_months(fact, lambda df: df).data, sites, vehicles)


def test_batches_of_changes_equal_a_rebuild(spark, golden, tmp_path):
    sites, vehicles = golden["dim_site"], golden["dim_vehicle"]
    kept = thin_gold.Maintained(spark, str(tmp_path / "thin"), FACT)
    draw, current = random.Random(6), {}
    for batch in range(4):
        names = [f"R{draw.randrange(60)}" for _ in range(40)]
        changes = {r[0]: r for r in rentals(draw, names)}
        df = spark.createDataFrame([*changes.values(), (None, "S1", "S1", False, DAY, 5.0, 1, False)], f"{FACT}, deleted boolean")
        assert kept.apply(df, "feed", batch)
        assert not kept.apply(df, "feed", batch)
        current |= changes
        if batch == 2:
            kept.compact()
            assert len(kept.table.snapshot().of("states")) == 1
        want, got = rebuilt(spark, current, sites, vehicles), thin_gold.tables(kept.states(), sites, vehicles)
        for name in want:
            assert rows(got[name], *want[name].columns) == rows(want[name]), (batch, name)
    live = {n for n, r in current.items() if not r[7]}
    assert {r.rental_id for r in kept.current().where("NOT _deleted").collect()} == live


def test_the_last_row_of_a_rental_counts_and_everything_can_go(spark, tmp_path):
    kept = thin_gold.Maintained(spark, str(tmp_path / "thin"), FACT)
    both = [("R1", "S1", "S1", False, DAY, v, 1, n) for n, v in ((1, 10.0), (2, 20.0))]
    kept.apply(spark.createDataFrame(both, f"{FACT}, seq int"), "feed", 0, order=["seq"])
    assert rows(kept.states(), "rows", F.col("exact_revenue_usd").cast("double")) == [(1, 20.0)]
    kept.apply(spark.createDataFrame([(*both[0][:7], True)], f"{FACT}, deleted boolean"), "feed", 1)
    assert kept.states().count() == 0
    kept.apply(spark.createDataFrame([(*both[0][:7], True)], f"{FACT}, deleted boolean"), "feed", 2)
    assert kept.states().count() == 0


def test_golden_aggregates_come_from_states(golden):
    stored = thin_gold.rental_months(golden["fact_rental"], lambda df: df).data
    for name, df in thin_gold.tables(stored, golden["dim_site"], golden["dim_vehicle"]).items():
        assert rows(df, *golden[name].columns) == rows(golden[name]), name
