from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from motorpool.plans import report
from motorpool.plans.semantic import MEASURES, NoPathError, evaluate, fleet_model, formatted, secure
from tests.conftest import rows


@pytest.fixture(scope="module")
def model(golden):
    return fleet_model({n: df for n, df in golden.items() if not n.startswith("kpi_")})


def test_all_measures_evaluate_without_grouping(model):
    assert len(MEASURES) == 27
    got = evaluate(model, list(MEASURES)).collect()
    assert len(got) == 1
    values = got[0].asDict()
    assert values["Total Rentals"] == 6
    assert values["Total Revenue"] == 669.66
    assert values["Revenue per Rental"] == pytest.approx(111.61)
    assert values["Active Vehicles"] == 4
    assert values["One-Way Rental %"] == pytest.approx(2 / 6)
    assert values["Idle Vehicle %"] == 0.25
    assert values["Fleet Utilization %"] == pytest.approx(39 / (2 * 31 + 2 * 31 + 2 * 29))
    assert values["Maintenance Cost"] == 168.75
    assert values["Avg Revenue per Rental"] == pytest.approx((164.58 + 58.64) / 2)
    assert values["Telematics Vehicles Tracked"] == 2


def test_sites_without_revenue_count_in_revenue_per_site(model):
    got = rows(evaluate(model, ["Revenue per Site"], by=["dim_site.state"]))
    assert got == [("OR", pytest.approx(175.93 / 2)), ("WA", 493.73)]


def test_groups_without_any_value_are_left_out(model):
    got = rows(evaluate(model, ["Total Rentals"], by=["dim_site.site_name"]))
    assert got == [("North", 3), ("South", 3)]


def test_fact_without_dimension_row_forms_a_null_group(model):
    got = dict(rows(evaluate(model, ["Total Rentals"], by=["dim_vehicle.make"])))
    assert got == {"m": 3, "n": 2, None: 1}


def test_measures_of_different_tables_do_not_multiply(model):
    got = rows(evaluate(model, ["Total Revenue", "Idle Vehicle Count", "Maintenance Cost"], by=["dim_site.city"]))
    assert got == [("Aville", 493.73, 1, 165.75), ("Btown", 175.93, 0, None), (None, None, None, 3.0)]


def test_filters_flow_from_dimension_to_fact_only(model):
    got = evaluate(model, ["Total Rentals", "Revenue per Site"], filters={"dim_vehicle.make": "m"}).first()
    # The vehicle filter reaches the fact, while all three sites stay in context.
    assert got["Total Rentals"] == 3
    assert got["Revenue per Site"] == pytest.approx(90.8 / 3)


def test_part_of_a_ratio_that_cannot_be_grouped_repeats(model):
    by_make = dict(rows(evaluate(model, ["Revenue per Site"], by=["dim_vehicle.make"])))
    assert by_make == {"m": pytest.approx(90.8 / 3), "n": pytest.approx(402.93 / 3), None: pytest.approx(175.93 / 3)}
    both = rows(evaluate(model, ["Revenue per Site"], by=["dim_site.state", "dim_vehicle.make"]))
    # Two sites lie in OR, one in WA.
    assert ("OR", None, pytest.approx(175.93 / 2)) in both
    assert ("WA", "m", pytest.approx(90.8)) in both
    sliced = evaluate(model, ["Revenue per Site"], by=["dim_vehicle.make"], filters={"dim_site.state": "OR"})
    assert dict(rows(sliced)) == {"m": 0.0, "n": 0.0, None: pytest.approx(175.93 / 2)}


def test_filter_forms(model):
    one = evaluate(model, ["Total Rentals"], filters={"dim_site.city": "Aville"}).first()[0]
    many = evaluate(model, ["Total Rentals"], filters={"dim_site.city": ["Aville", "Btown"]}).first()[0]
    rule = evaluate(model, ["Total Rentals"], filters={"fact_rental.miles_driven": lambda c: c >= 100}).first()[0]
    assert (one, many, rule) == (3, 6, 3)


def test_direct_path_wins_over_the_path_through_vehicles(model):
    assert [r.name for r in model.path("fact_rental", "dim_site")] == ["rel_rental_site"]


def test_inactive_relationship_replaces_the_active_one(model):
    start = rows(evaluate(model, ["One-Way Revenue"], by=["dim_site.city"]))
    end = rows(evaluate(model, ["One-Way Revenue"], by=["dim_site.city"], use=["rel_oneway_return_site"]))
    assert start == [("Aville", 402.93), ("Btown", 175.93)]
    assert end == [("Aville", 175.93), ("Btown", 402.93)]


def test_grouping_without_a_path_is_refused(model):
    with pytest.raises(NoPathError):
        evaluate(model, ["Monthly Revenue"], by=["dim_site.city"])
    with pytest.raises(KeyError):
        evaluate(model, ["Total Rentals"], use=["no_such_relationship"])


def test_secured_model(spark, model):
    grants = spark.createDataFrame([("ana", "Aville")], "principal string, city string")
    seen = secure(model, "dim_site", "city", grants, "ana")
    assert rows(evaluate(seen, ["Total Revenue"], by=["dim_site.city"])) == [("Aville", 493.73)]
    assert evaluate(seen, ["Total Revenue"]).first()[0] == 493.73
    # No path to the site: nothing is shown.
    assert evaluate(seen, ["Monthly Revenue"]).first()[0] is None
    # A stranger sees nothing.
    assert evaluate(secure(model, "dim_site", "city", grants, "eve"), ["Total Rentals"]).first()[0] == 0


def test_report_questions(model):
    cards = report.kpi_cards(model).first()
    assert cards["Total Revenue"] == 669.66 and cards["Idle Vehicle Count"] == 1
    assert rows(report.revenue_by_city(model)) == [("Aville", 493.73), ("Btown", 175.93)]
    assert rows(report.site_map(model)) == [("Aville", 493.73, 1.0, 2.0), ("Btown", 175.93, 3.0, 4.0)]
    tree = rows(report.revenue_decomposition(model), "depth", "state", "city", "class_name", "Total Revenue")
    assert (0, None, None, None, 669.66) in tree
    assert (3, "WA", "Aville", "Economy", 90.8) in tree


def test_formatted_answers(model):
    names = ["Total Rentals", "Total Revenue", "Revenue per Rental", "One-Way Rental %", "Average Rental Duration"]
    shown = formatted(model, evaluate(model, names, by=["dim_site.city"]))
    assert rows(shown)[0] == ("Aville", "3", "$494", "$164.58", "33.3%", "1.7")


def test_forecast_continues_a_straight_line(spark):
    data = [("a", date(2024, m, 1), 10.0 * m) for m in range(1, 5)] + [("b", date(2023, 11, 1), 7.0)]
    series = spark.createDataFrame(data, "site string, month date, usd double")
    got = report.forecast_linear(series, ["site"], "month", "usd").orderBy("site", "step").collect()
    assert [r.forecast for r in got if r.site == "a"] == [pytest.approx(x) for x in (50.0, 60.0, 70.0)]
    assert [str(r.month) for r in got if r.site == "a"] == ["2024-05-01", "2024-06-01", "2024-07-01"]
    assert all(r.lower == pytest.approx(r.forecast) for r in got if r.site == "a")
    # One month makes no line.
    assert all(r.forecast is None and r.upper is None for r in got if r.site == "b")


@pytest.mark.parametrize("column", ["dim_sites.state", "dim_site.stat", "nothing.x"])
def test_filter_on_what_the_model_lacks_is_refused(model, column):
    with pytest.raises(KeyError, match="no column"):
        evaluate(model, ["Total Revenue"], filters={column: "X"})


def test_forecast_sums_to_its_own_grain(spark):
    data = [(s, date(2024, m, 1), 100.0 * k) for m in range(1, 5) for k, s in ((1, "s1"), (3, "s2"))]
    series = spark.createDataFrame(data, "site string, month date, usd double").selectExpr("'c' as city", "*")
    for by in (["city"], []):
        got = report.forecast_linear(series, by, "month", "usd").collect()
        assert len(got) == 3
        for r in got:
            assert (r.forecast, r.lower, r.upper) == tuple(pytest.approx(x) for x in (400.0, 400.0, 400.0))


def test_forecast_counts_missing_months(spark):
    data = [("a", date(2024, 1, 1), 0.0), ("a", date(2024, 2, 1), 10.0), ("a", date(2024, 5, 1), 40.0)]
    series = spark.createDataFrame(data, "site string, month date, usd double")
    got = report.forecast_linear(series, ["site"], "month", "usd", horizon=1).first()
    assert got.forecast == pytest.approx(50.0)


def test_order_of_rows_does_not_matter_to_measures(golden):
    fact = golden["fact_rental"]
    shuffled = {**{n: golden[n] for n in ("dim_site", "dim_vehicle", "dim_customer")}, "fact_rental": fact.orderBy(F.rand(1))}
    got = evaluate(fleet_model(shuffled), ["Total Revenue"], by=["dim_customer.loyalty_tier"])
    assert rows(got) == [("Gold", 266.73), ("None", 402.93)]
