from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from motorpool.operators import cleaning
from motorpool.schemas import ENTITIES, RENTALS
from tests.conftest import rows, ts


def test_dedup_drops_null_keys_and_is_independent_of_partitions(spark):
    data = [("a", 1, "x"), ("a", 2, "w"), ("a", 2, "v"), (None, 9, "z"), ("b", None, "q")]
    expected = [("a", 2, "v"), ("b", None, "q")]
    for parts, order in ((1, data), (5, data[::-1])):
        df = spark.createDataFrame(order, "k string, n int, s string").repartition(parts)
        assert rows(cleaning.dedup(df, "k", [F.col("n").desc_nulls_last()])) == expected


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-5, 5)), min_size=1, max_size=20))
def test_dedup_twice_is_dedup_once(spark, data):
    df = spark.createDataFrame(data, "k int, v int")
    once = cleaning.dedup(df, "k")
    assert rows(cleaning.dedup(once, "k")) == rows(once)
    assert rows(once) == sorted({k: min(v for j, v in data if j == k) for k, _ in data}.items())


def test_latest_per_key(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("a", None), ("b", 2)], "k string, t int")
    assert rows(cleaning.latest_per(df, "k", "t")) == [("a", 3), ("b", 2)]


def test_casts_turn_bad_values_into_null(spark):
    df = spark.createDataFrame(
        [("12", "2500.0", 7.0, "true", "2024-01-02"), ("x", "NaN", float("nan"), "maybe", "2024-13-01")],
        "a string, b string, c double, d string, e string",
    )
    cast = cleaning.cast_columns(df, {"a": "int", "b": "long", "c": "long", "d": "boolean", "e": "date"})
    assert [t for _, t in cast.dtypes] == ["int", "bigint", "bigint", "boolean", "date"]
    got = [tuple(r) for r in cast.withColumn("e", F.col("e").cast("string")).collect()]
    assert got == [(12, 2500, 7, True, "2024-01-02"), (None, None, None, None, None)]


def test_text_folding(spark):
    df = spark.createDataFrame([(" Wa ", " iDle ", " x ")], "a string, b string, c string")
    assert rows(cleaning.normalize_text(df, {"a": "upper", "b": "lower", "c": "trim"})) == [("WA", "idle", "x")]


def test_audit_columns_come_and_go(spark):
    df = spark.createDataFrame([(1,), (2,)], "n int")
    audited = cleaning.with_audit(df, "shop", "raw", "b-1", ts("2024-01-01T00:00"))
    assert audited.columns == ["n", *cleaning.AUDIT_COLUMNS]
    assert rows(audited, "_source_system", "_batch_id") == [("shop", "b-1")] * 2
    assert cleaning.read_without(audited).columns == ["n"]
    assert cleaning.read_without(df).columns == ["n"]


def test_raw_rentals_become_silver(spark):
    raw = spark.createDataFrame(
        [
            ("RN1", "C1", " Closed ", "2024-01-01T10:00:00Z", "2024-01-03T09:00:00Z", 10.0, "extra"),
            ("RN1", "C1", " Closed ", "2024-01-01T10:00:00Z", "2024-01-03T09:00:00Z", 10.0, "extra"),
            ("RN2", "C2", "OPEN", "2024-01-05T10:00:00Z", None, float("nan"), "extra"),
            (None, "C2", "open", "2024-01-05T10:00:00Z", None, None, "extra"),
        ],
        "rental_id string, customer_id string, status string, pickup_ts string, return_ts string, miles_driven double,"
        " later_column string",
    )
    bronze = cleaning.with_audit(raw, "s", "raw", "b", ts("2024-01-01T00:00"))
    got = cleaning.to_silver(RENTALS, bronze)
    assert rows(got, "rental_id", "status", "miles_driven", "rental_days") == [
        ("RN1", "closed", 10, 2),
        ("RN2", "open", None, None),
    ]
    assert "later_column" in got.columns and "_batch_id" not in got.columns
    assert dict(got.dtypes)["pickup_ts"] == "timestamp"


def test_declared_schemas_agree_with_their_references():
    for entity in ENTITIES.values():
        assert entity.key in entity.columns
        assert set(entity.refs) <= set(entity.columns)
        assert set(entity.refs.values()) <= set(ENTITIES)
        assert set(entity.enums) <= set(entity.columns)
        assert entity.schema().names == entity.raw_schema().names


def test_whole_numbers_are_never_cut(spark):
    from motorpool.operators.cleaning import cast_columns

    texts = ["2500", "2500.0", "2500.7", " 12 ", "1e3", "x", None, "9223372036854775807", "-3.0"]
    df = spark.createDataFrame([(t,) for t in texts], "n string")
    assert [r.n for r in cast_columns(df, {"n": "long"}).collect()] == [2500, 2500, None, 12, 1000, None, None, 2**63 - 1, -3]
    numbers = spark.createDataFrame([(2500.0,), (2500.7,), (float("nan"),), (None,)], "n double")
    assert [r.n for r in cast_columns(numbers, {"n": "int"}).collect()] == [2500, None, None, None]


def test_numbers_in_odd_text_are_read_as_by_a_cast(spark):
    texts = ["1.5", " 2 ", "1e3", ".5", "n/a", "no", "", None, "NaN", "nan", "inf", "-Infinity", "+INF", "infin", "0x1p3", "1,5", "x1", "\u0661"]
    df = spark.createDataFrame([(t, t) for t in texts], "t string, n string")
    both = cleaning.cast_columns(df, {"n": "double"}).select("t", F.col("t").try_cast("double").alias("plain"), "n")
    assert rows(both.filter("not (plain <=> n)")) == [] and both.filter("n is not null").count() >= 9
