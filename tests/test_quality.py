from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from motorpool.operators import quality
from motorpool.schemas import EVENT, PAYMENTS, VEHICLES
from tests.conftest import rows


def test_reference_report_and_stop(silver):
    relations = [("rentals", "vehicle_id", "vehicles"), ("rentals", "pickup_site_id", "sites")]
    assert rows(quality.check_fks(silver, relations)) == [
        ("rentals", "pickup_site_id", "sites", 0),
        ("rentals", "vehicle_id", "vehicles", 1),
    ]
    with pytest.raises(quality.QualityError, match=r"rentals.vehicle_id -> vehicles: 1 orphans"):
        quality.require_fks(silver, relations)
    quality.require_fks(silver, relations[1:])


def test_declared_relations_of_some_tables():
    found = quality.entity_relations(["vehicles", "sites"])
    assert found == [("vehicles", "home_site_id", "sites"), ("vehicles", "current_site_id", "sites")]


def test_empty_tables_stop(silver):
    quality.check_non_empty(silver)
    with pytest.raises(quality.QualityError, match="empty: sites"):
        quality.check_non_empty({**silver, "sites": silver["sites"].limit(0)})


def test_key_report(spark):
    df = spark.createDataFrame([("a",), ("a",), ("a",), ("b",), (None,), (None,)], "k string")
    assert rows(quality.check_pk(df, "k")) == [(6, 2, 1, 2)]
    assert rows(quality.check_pk(df.limit(0), "k")) == [(0, 0, 0, 0)]


def test_contract(spark):
    df = spark.createDataFrame(
        [("V1", "idle"), ("V2", "lost"), (None, None)], "vehicle_id string, status string"
    )
    got = dict(rows(quality.validate(df, quality.contract_of(VEHICLES, df.columns))))
    missing = {f"missing:{c}": 3 for c in VEHICLES.required if c not in df.columns}
    assert got == {"required:vehicle_id": 1, "required:status": 1, "enum:status": 1, **missing}
    assert "missing:vin" in missing
    assert "enum:currency" in quality.contract_of(PAYMENTS)


def test_types_of_raw_text(spark):
    df = spark.createDataFrame([("5", "true"), ("five", "maybe"), (None, None)], "idle_minutes string, is_spike string")
    got = dict(rows(quality.validate(df, quality.type_rules(EVENT, df.columns))))
    assert got == {"type:idle_minutes": 1, "type:is_spike": 1}


def test_no_number_is_a_violation(spark):
    df = spark.createDataFrame([("NaN",), ("1.5",), ("x",), (None,)], "latitude string")
    assert rows(quality.validate(df, quality.type_rules(EVENT, df.columns))) == [("type:latitude", 2)]


def test_keys_of_a_child_are_checked_in_one_pass(spark):
    child = spark.createDataFrame([(1, 1, "a"), (2, 9, None), (None, 1, "z")], "x int, y long, z string")
    parents = {"child": child, "p": spark.createDataFrame([(1,), (2,)], "k long"), "q": spark.createDataFrame([("a",)], "k string")}
    relations = [("child", "x", "p"), ("child", "y", "p"), ("child", "z", "q")]
    found = quality.check_fks(parents, relations, {"p": "k", "q": "k"})
    assert rows(found) == [("child", "x", "p", 0), ("child", "y", "p", 1), ("child", "z", "q", 1)]


def test_fingerprint_ignores_order_and_sees_change(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "n int, s string")
    same = df.orderBy(F.desc("n")).repartition(3).select("s", "n")
    assert rows(quality.fingerprint(df)) == rows(quality.fingerprint(same))
    assert rows(quality.fingerprint(df)) != rows(quality.fingerprint(df.distinct()))
    changed = df.withColumn("s", F.lit("a"))
    assert rows(quality.fingerprint(df)) != rows(quality.fingerprint(changed))


def test_same_rows_sees_multiplicity(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "n int")
    b = spark.createDataFrame([(1,), (2,), (3,)], "n int")
    assert rows(quality.same_rows(a, b)) == [(1, "left"), (3, "right")]
    assert rows(quality.compare(a, b)) == [(3, 3, 2)]
    quality.assert_same(a, a.orderBy("n"))
    with pytest.raises(quality.QualityError):
        quality.assert_same(a, b)


def test_reconcile(spark):
    a = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("y", 5.0), (None, 1.0)], "k string, v double")
    b = spark.createDataFrame([("x", 3.005), ("z", 1.0), (None, 1.0)], "k string, v double")
    got = quality.reconcile(a, b, ["k"], {"v": F.sum("v")}, tolerance=0.01)
    assert rows(got, "k", "measure", "matches") == [("x", "v", True), ("y", "v", False), ("z", "v", False), (None, "v", True)]


def test_personal_data_is_found_by_column(silver, spark):
    found = quality.classify_pii(silver["customers"]).filter("is_pii")
    assert rows(found, "column", "kind", "ratio") == [("email", "email", 1.0), ("phone", "phone", 1.0)]
    empty = spark.createDataFrame([], "note string")
    assert rows(quality.classify_pii(empty), "matches", "ratio", "is_pii") == [(0, None, False)] * 2


def test_whole_values_are_searched(spark):
    late = spark.createDataFrame([("x" * 100_000 + " me@example.com",)], "note string")
    assert rows(quality.classify_pii(late).filter("is_pii"), "kind") == [("email",)]


def test_equal_tables_exchange_digests_only(spark):
    """No rows meet unless a bucket differs; a changed row marks its bucket alone."""
    left = spark.range(20_000).selectExpr("id", "id % 7 as v", "cast(id as double) / 3 as d").repartition(5)
    right = spark.range(20_000).selectExpr("id", "id % 7 as v", "cast(id as double) / 3 as d").repartition(3)
    assert quality.differing_buckets(left, right).count() == 0 and quality.same_rows(left, right).count() == 0
    changed = right.selectExpr("id", "if(id = 77, 99, v) as v", "d")
    assert quality.differing_buckets(left, changed, ["id"]).count() == 1
    assert rows(quality.same_rows(left, changed, ["id"]), "id", "v", "side") == [(77, 0, "left"), (77, 99, "right")]
    assert quality.differing_buckets(left, changed).count() == 2
    assert rows(quality.same_rows(left, changed), "id", "v", "side") == [(77, 0, "left"), (77, 99, "right")]
    twice = right.union(right.where("id = 5"))
    assert rows(quality.same_rows(left, twice, buckets=8), "id", "side") == [(5, "right")]
    some_null = spark.createDataFrame([(None, 1), (2, None)], "k int, v int")
    assert quality.same_rows(some_null, some_null).count() == 0 and quality.same_rows(some_null, some_null.limit(0)).count() == 2
