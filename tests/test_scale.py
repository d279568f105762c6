"""What must hold for plans on large, skewed data."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from motorpool.operators import cleaning, gold, joins, ranking, rollups
from motorpool.plans import medallion
from motorpool.sources import tables
from tests.conftest import rows

LIBRARY = sorted((Path(__file__).resolve().parent.parent / "motorpool").rglob("*.py"))
# The operators on training text have tests of their own, and broadcast what is proven small.
LIBRARY = [p for p in LIBRARY if p.parent.name != "llm"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_joins_shuffle(spark):
    """Settings under which test data is planned like large data: no broadcast, low skew limits."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def skewed(spark, count=120_000):
    """A third of the rows under one key, the rest spread out."""
    hot = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5_000)
    return spark.range(0, count, 1, 12).select(
        F.col("id").alias("rental_id"), hot.alias("vehicle_id"), F.hash("id").cast("double").alias("x")
    )


def test_library_stays_on_the_executors():
    forbidden = r"localCheckpoint|crossJoin|toPandas|\.rdd\b|\budf\(|pandas_udf|applyInPandas|mapInPandas|broadcast\("
    for path in LIBRARY:
        assert not re.search(forbidden, path.read_text()), path


def test_duplicates_are_dropped_before_the_shuffle(spark):
    plan = plan_of(cleaning.dedup(skewed(spark), "vehicle_id", [F.col("x").desc()]))
    before_shuffle = plan[plan.index("Exchange") :]
    assert "WindowGroupLimit" in before_shuffle and "Partial" in before_shuffle


def test_top_k_per_group_is_cut_before_the_shuffle(spark):
    plan = plan_of(ranking.top_k(skewed(spark), "x", 3, keys=["rental_id"], within=["vehicle_id"]))
    assert "WindowGroupLimit" in plan[plan.index("Exchange") :]
    overall = plan_of(ranking.top_k(skewed(spark), "x", 3, ties=True))
    assert "TakeOrderedAndProject" in overall and "BroadcastHashJoin" in overall
    assert "TakeOrderedAndProject" in plan_of(ranking.top_k(skewed(spark), "x", 3, keys=["rental_id"]))


def test_tied_rows_stay_where_they_are(spark):
    df = spark.range(40_000).selectExpr("id", "if(id < 2, 5, 1) as n").repartition(8)
    top = ranking.top_k(df, "n", 3, ties=True)
    assert top.count() == 40_000
    assert {tuple(r) for r in top.select("n", "rank").distinct().collect()} == {(5, 1), (1, 3)}
    sizes = top.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 8_000


def test_hot_key_with_all_its_readings_in_one_day(spark):
    df = spark.range(30_000).selectExpr(
        "if(id % 3 = 0, 7, id) as vehicle_id", "id as event_id", "id * 10 as miles",
        "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id % 20000) as ts",
    )
    got = ranking.change(df, "vehicle_id", "ts", "miles", tiebreak="event_id", slice_rows=500)
    from pyspark.sql import Window

    plain = F.lag("miles").over(Window.partitionBy("vehicle_id").orderBy("ts", "event_id"))
    want = df.withColumn("previous_miles", plain)
    assert rows(got, "event_id", "previous_miles") == rows(want, "event_id", "previous_miles")


def test_hot_key_is_split_in_a_lookup(spark, small_joins_shuffle):
    dim = spark.range(5_000).select(F.col("id").alias("vehicle_id"), F.lit("K").alias("class_name"))
    joined = joins.lookup(skewed(spark), dim, "vehicle_id")
    joined.write.format("noop").mode("overwrite").save()
    result = joined.groupBy("vehicle_id").agg(F.count("class_name").alias("n"))
    assert result.agg(F.sum("n")).first()[0] == 120_000
    top = ranking.top_k(result, "n", 1, keys=["vehicle_id"])
    assert rows(top) == [(7, 40_016)]
    assert "skew=true" in plan_of(top)


def test_null_keys_are_dealt_over_tasks(spark, small_joins_shuffle):
    fact = skewed(spark).withColumn("vehicle_id", F.when(F.col("vehicle_id") != 7, F.col("vehicle_id")))
    dim = spark.range(5_000).select(F.col("id").alias("vehicle_id"), F.lit("K").alias("class_name"))
    joined = joins.lookup(fact, dim, "vehicle_id", spread_nulls_by="rental_id")
    assert joined.count() == 120_000
    slices = fact.filter("vehicle_id is null").select(F.pmod(F.xxhash64("rental_id"), F.lit(joins.NULL_SLICES)))
    assert slices.distinct().count() == joins.NULL_SLICES


def test_hot_rental_is_summed_before_the_shuffle(spark):
    paid = skewed(spark).select(
        F.col("vehicle_id").alias("rental_id"),
        *[F.col("x").alias(c) for c in ("total_amount_usd", *gold.AMOUNTS)],
    )
    plan = plan_of(gold.payments_by_rental(paid))
    assert "partial_sum" in plan[plan.index("Exchange") :]


def test_orphans_reduce_the_child_first(spark, small_joins_shuffle):
    parent = spark.range(4_000).select(F.col("id").alias("vehicle_id"))
    plan = plan_of(joins.orphan_keys(skewed(spark), "vehicle_id", parent, "vehicle_id"))
    assert "partial_count" in plan[plan.index("Exchange") :]
    assert joins.orphans(skewed(spark), "vehicle_id", parent, "vehicle_id").count() == 16_000


def test_change_of_a_hot_key_is_cut_into_slices(spark):
    minutes = F.col("id").cast("double") * 60
    df = spark.range(30_000).select(
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("vehicle_id"),
        F.timestamp_seconds(minutes).alias("ts"),
        F.col("id").alias("miles"),
    )
    got = ranking.change(df, "vehicle_id", "ts", "miles", tiebreak="event_id")
    assert "hashpartitioning(vehicle_id" in plan_of(got) and "_slice" in plan_of(got)
    per_key = got.groupBy("vehicle_id").agg(F.count("*").alias("n"), F.count("previous_miles").alias("m"))
    assert per_key.filter("n <> m + 1").count() == 0
    assert got.filter("miles_change <= 0").count() == 0


def test_filters_and_columns_reach_the_scan(spark, silver, tmp_path):
    path = str(tmp_path / "v")
    silver["vehicles"].write.parquet(path)
    plan = plan_of(gold.fleet_size(spark.read.parquet(path).filter("status = 'idle'"), "current_site_id"))
    assert "PushedFilters: [IsNotNull(status), EqualTo(status,idle)]" in plan
    assert "ReadSchema: struct<vehicle_id:string,current_site_id:string,status:string>" in plan


def test_bucketed_rentals_stay_in_place(spark, silver, small_joins_shuffle):
    stored = tables.overwrite_table(silver["rentals"], "bucketed_rentals", bucket_by=(8, "rental_id"))
    assert rows(stored, "rental_id", "pickup_ts") == rows(silver["rentals"], "rental_id", "pickup_ts")
    fact = medallion.fact({**silver, "rentals": stored}, ("rental_id", "pickup_site_id", "revenue_usd"))
    # Only the payments move.
    assert plan_of(fact).count("Exchange") == 1
    assert rows(fact) == rows(medallion.fact(silver, ("rental_id", "pickup_site_id", "revenue_usd")))


def test_unique_rentals_are_counted_without_moving_their_ids(golden):
    fact = golden["fact_rental"]
    plain, promised = gold.kpi_revenue_by_site(fact), gold.kpi_revenue_by_site(fact, unique=True)
    assert rows(plain) == rows(promised)
    assert "distinct" in plan_of(plain) and "distinct" not in plan_of(promised)
    assert rows(rollups.agg_revenue_by_site_month(fact, unique=True)) == rows(rollups.agg_revenue_by_site_month(fact))
    assert rows(gold.kpi_one_way_flows(fact, unique=True)) == rows(gold.kpi_one_way_flows(fact))
