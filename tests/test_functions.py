from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from motorpool.functions import calendar, money, text
from tests.conftest import rows, ts


@pytest.mark.parametrize(
    ("start", "end", "by_calendar", "by_elapsed"),
    [
        ("2024-01-05T08:00", "2024-01-05T18:00", 1, 1),
        ("2024-01-10T22:00", "2024-01-11T02:00", 1, 1),
        ("2024-01-10T22:00", "2024-01-12T02:00", 2, 1),
        ("2024-01-10T08:00", "2024-01-12T08:00", 2, 2),
        ("2024-01-10T08:00", None, None, None),
    ],
)
def test_two_kinds_of_rental_days(spark, start, end, by_calendar, by_elapsed):
    df = spark.createDataFrame([(ts(start), ts(end) if end else None)], "a timestamp, b timestamp")
    got = df.select(
        calendar.rental_days_calendar(F.col("a"), F.col("b")), calendar.rental_days_elapsed(F.col("a"), F.col("b"))
    ).first()
    assert tuple(got) == (by_calendar, by_elapsed)


def test_iso_text_round_trip_and_bad_text(spark):
    df = spark.createDataFrame([("2024-02-29T23:59:59Z",), ("2024-02-30T00:00:00Z",), ("x",), (None,)], "t string")
    got = df.select("t", calendar.format_iso(calendar.parse_iso("t")).alias("back")).collect()
    assert [r.back for r in got] == ["2024-02-29T23:59:59Z", None, None, None]


def test_iso_text_of_any_shape_parses_as_by_the_pattern(spark):
    texts = """2024-02-29T23:59:59Z 2023-02-29T00:00:00Z 0000-01-01T00:00:00Z 0001-01-01T00:00:00Z 2024-01-01T24:00:00Z
        2024-01-01T23:59:60Z 2024-13-01T00:00:00Z 1582-10-10T12:00:00Z +12024-01-01T00:00:00Z 2024-01-01t10:00:00z 2024-01-01
        2024-01-01T10:00:00 2024-01-01T10:00:00.5Z 2024-01-01T10:00:00+01:00 2024-03-31T02:30:00Z -2024-01-01T00:00:00Z""".split()
    texts += ["2024-01-01T10:00:00Z\n", " 2024-01-01T10:00:00Z", "2024-01-01 10:00:00Z", "no date", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.try_to_timestamp("t", F.lit(calendar.ISO_UTC))
    try:
        for zone in ("UTC", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            both = df.select("t", plain.alias("plain"), calendar.parse_iso("t").alias("got"))
            assert rows(both.filter("not (plain <=> got)")) == [] and both.filter("got is not null").count() >= 5
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_months(spark):
    df = spark.createDataFrame([(ts("2024-02-10T00:00"),), (ts("2023-02-10T00:00"),)], "t timestamp")
    got = rows(df, calendar.month_of("t").cast("string"), calendar.days_in_month("t"))
    assert got == [("2023-02-01", 28), ("2024-02-01", 29)]


def test_not_empty_rejects_null_and_empty_text(spark):
    df = spark.createDataFrame([("P0300",), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(text.not_empty("c")).collect()] == [True, False, False]


def test_keys_keep_wide_numbers_whole(spark):
    df = spark.createDataFrame([(12,), (1234567,)], "n long")
    assert rows(df, text.formatted_key("V", 5, F.col("n"))) == [("V00012",), ("V1234567",)]


def test_price_formula(spark):
    df = spark.createDataFrame([(90.0, 3, True), (39.0, 1, False)], "rate double, days int, one_way boolean")
    cols = money.price_columns(F.col("rate"), F.col("days"), F.col("one_way"))
    assert rows(df, *[c.alias(n) for n, c in cols.items()]) == [(270.0, 75.0, 46.58, 391.58), (39.0, 0.0, 5.27, 44.27)]


def test_division_by_zero_is_null(spark):
    df = spark.createDataFrame([(1, 0), (1, 2), (1, None)], "a int, b int")
    assert [r[0] for r in df.select(money.safe_div(F.col("a"), F.col("b"))).collect()] == [None, 0.5, None]


def test_percent_rounds_the_exact_quotient(spark):
    df = spark.createDataFrame([(444, 24000), (1, 0)], "a long, b long")
    assert [r[0] for r in df.select(money.percent(F.col("a"), F.col("b"))).collect()] == [1.9, None]


def test_total_is_exact_in_any_order(spark):
    amounts = [0.1, 0.2, 0.3, -0.6, 1e11, -1e11, 0.0001] * 50
    forward = spark.createDataFrame([(a,) for a in amounts], "x double").repartition(7)
    backward = spark.createDataFrame([(a,) for a in reversed(amounts)], "x double").repartition(3)
    for df in (forward, backward):
        assert float(df.select(money.exact_sum("x")).first()[0]) == 0.005


def test_total_beyond_one_long(spark):
    df = spark.range(2_000).select(F.lit(9e11).alias("x"))
    assert df.select(money.exact_sum("x").cast("double")).first()[0] == 1.8e15


def test_total_keeps_more_decimals_than_expected(spark):
    df = spark.range(200).select(F.lit(0.00004).alias("x"))
    assert float(df.select(money.exact_sum("x")).first()[0]) == 0.008
    assert float(df.select(money.exact_sum("x", decimals=2)).first()[0]) == 0.008


def test_no_number_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "x double")
    assert float(df.select(money.exact_sum("x")).first()[0]) == 1.0
    assert df.limit(1).select(money.exact_sum("x")).first()[0] is None


@pytest.mark.parametrize("amount", [1e18, -1e300, float("inf")])
def test_an_amount_too_large_to_add_stops(spark, amount):
    with pytest.raises(Exception, match="amount too large"):
        spark.createDataFrame([(amount,)], "x double").select(money.exact_sum("x")).collect()


def test_total_of_nothing_is_null(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert df.select(money.usd_sum("x"), money.usd_avg("x")).first() == (None, None)


def test_display(spark):
    df = spark.createDataFrame([(1234.4,), (-5.0,)], "x double")
    assert [r[0] for r in df.select(money.display_usd("x")).collect()] == ["$1,234", "($5)"]
    assert df.select(money.display_percent(F.lit(0.1234))).first()[0] == "12.3%"
