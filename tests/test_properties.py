"""Laws that hold for any data."""

from __future__ import annotations

from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from motorpool.operators import joins, policy, rollups
from motorpool.operators.cleaning import rental_days
from motorpool.plans import medallion
from tests.conftest import rows

few = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
keys = st.one_of(st.none(), st.integers(0, 5).map(lambda i: f"k{i}"))
hours = st.integers(0, 24 * 90)


def _rentals(spark, spans):
    start = datetime(2024, 1, 20)
    data = []
    for i, (begin, length) in enumerate(spans):
        pickup = start + timedelta(hours=begin)
        back = None if length is None else pickup + timedelta(hours=length)
        data.append((f"R{i}", "S1", "S1", "V1", pickup, back))
    df = spark.createDataFrame(
        data,
        "rental_id string, pickup_site_id string, return_site_id string, vehicle_id string, pickup_ts timestamp,"
        " return_ts timestamp",
    )
    return rental_days(df)


@few
@given(st.lists(st.tuples(hours, st.one_of(st.none(), hours)), min_size=1, max_size=12))
def test_days_by_month_add_up_to_rental_days(spark, spans):
    rentals = _rentals(spark, spans)
    parts = rollups.days_by_month(rentals)
    assert parts.filter("days < 1 or days > 31").count() == 0
    total = dict(rows(parts.groupBy("rental_id").agg(F.sum("days"))))
    assert total == dict(rows(rentals.filter("rental_days is not null"), "rental_id", "rental_days"))


@few
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(-10_000, 1_000_000)), max_size=25))
def test_fact_total_is_the_total_of_payments_with_a_rental(spark, silver, paid):
    rentals = _rentals(spark, [(24 * i, 30) for i in range(5)])
    payments = spark.createDataFrame(
        [(f"R{r}", c / 100, 0.0, 0.0, c / 100) for r, c in paid],
        "rental_id string, base_amount_usd double, one_way_fee_usd double, taxes_fees_usd double,"
        " total_amount_usd double",
    )
    fact = medallion.fact({**silver, "rentals": rentals, "payments": payments}, ("rental_id", "revenue_usd"))
    assert fact.count() == 5
    got = sum(round(v * 100) for _, v in rows(fact))
    assert got == sum(c for r, c in paid if r < 5)


@few
@given(st.lists(keys, max_size=20), st.lists(keys, max_size=8))
def test_every_child_row_resolves_is_an_orphan_or_has_no_key(spark, children, parents):
    child = spark.createDataFrame([(i, k) for i, k in enumerate(children)], "n int, k string")
    parent = spark.createDataFrame([(k,) for k in parents], "p string")
    known = {k for k in parents if k is not None}
    found = joins.fk_resolves(child, "k", parent, "p").first()
    assert found.child_rows == len(children) == found.resolved_rows + found.orphan_rows + found.null_keys
    assert found.resolved_rows == sum(k in known for k in children)
    lost = rows(joins.orphans(child, "k", parent, "p"))
    assert lost == sorted(((i, k) for i, k in enumerate(children) if k is not None and k not in known), key=repr)


@few
@given(st.lists(st.text(max_size=12), min_size=1, max_size=10), st.sets(st.sampled_from(["a", "b", "pii"])))
def test_masks_show_all_or_nothing(spark, values, groups):
    df = spark.createDataFrame([(v,) for v in values], "email string")
    shown = {r[0] for r in policy.mask(df, "email", groups, {"pii"}, "#").collect()}
    assert shown == (set(values) if "pii" in groups else {"#"})
