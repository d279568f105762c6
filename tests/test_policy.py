from __future__ import annotations

import pytest

from motorpool.operators import gold, governance, policy
from motorpool.plans import medallion, semantic
from tests.conftest import rows

BRANCHES = (("admins", policy.ALL), ("north", "Aville"), ("south", "Btown"))


@pytest.fixture(scope="module")
def curated(silver):
    return gold.rentals_curated(silver["rentals"], silver["sites"])


@pytest.mark.parametrize(
    ("groups", "seen"),
    [
        ({"admins"}, ["R1", "R2", "R3", "R4", "R5", "R6"]),
        ({"north"}, ["R1", "R2", "R4"]),
        ({"south", "north"}, ["R1", "R2", "R4"]),
        ({"north", "admins"}, ["R1", "R2", "R3", "R4", "R5", "R6"]),
        ({"others"}, []),
        (set(), []),
    ],
)
def test_first_matching_group_decides(curated, groups, seen):
    got = policy.row_filter(curated, "site_city", groups, BRANCHES)
    assert [r[0] for r in rows(got, "rental_id")] == seen


def test_mask_never_leaks(silver):
    masked = policy.mask(silver["customers"], "email", {"staff"}, {"pii"})
    assert rows(masked, "email") == [(policy.MASK,)] * 2
    assert rows(policy.mask(silver["customers"], "email", {"pii", "staff"}, {"pii"})) == rows(silver["customers"])


@pytest.mark.parametrize("kind", ["mask", "hide", "row_filter"])
def test_rules_find_columns_as_spark_does(silver, kind):
    who = policy.Principal("x", frozenset({"north"}))
    column = "HOME_City" if kind == "row_filter" else "EMAIL"
    got = policy.apply_policies(silver["customers"], "customers", who, [policy.Policy("Customers", kind, column, branches=BRANCHES)])
    if kind == "row_filter":
        assert {r.home_city for r in got.collect()} == {"Aville"}
    else:
        assert got.count() == 2 and "ann@example.com" not in repr(got.collect())


@pytest.mark.parametrize("kind", ["mask", "hide", "row_filter", "unheard_of"])
def test_a_rule_that_cannot_be_applied_denies(silver, kind):
    who = policy.Principal("x", frozenset({"admins"}))
    got = policy.apply_policies(silver["customers"], "customers", who, [policy.Policy("customers", kind, "e_mail", branches=BRANCHES)])
    assert got.count() == 0


def test_a_mask_holds_beside_a_hidden_column(silver):
    who = policy.Principal("x", frozenset())
    rules = [policy.Policy("customers", "hide", "phone"), policy.Policy("customers", "mask", "phone"), policy.Policy("customers", "mask", "Email")]
    got = policy.apply_policies(silver["customers"], "customers", who, rules)
    assert "phone" not in got.columns and {r.email for r in got.collect()} == {policy.MASK}


def test_hidden_columns_are_gone(silver):
    assert not {"email", "phone"} & set(policy.hide(silver["customers"], ["email", "phone"]).columns)


def test_rls_by_mapping(spark, silver):
    grants = spark.createDataFrame([("ana", "Aville"), ("ana", "Aville"), ("ben", "Btown")], "principal string, city string")

    def seen(user, key="pickup_site_id"):
        got = policy.rls(silver["rentals"], key, silver["sites"], "site_id", "city", grants, user)
        return [r[0] for r in rows(got, "rental_id")]

    assert seen("ana") == ["R1", "R2", "R4"]
    assert seen("ben") == ["R3", "R5", "R6"]
    assert seen("eve") == []
    assert seen("ana", key=None) == []


def test_policy_set(silver):
    rules = [
        policy.Policy("customers", "mask", "email", allowed=("pii",), literal="***"),
        policy.Policy("customers", "hide", "phone", allowed=("pii",)),
        policy.Policy("customers", "row_filter", "home_city", branches=BRANCHES),
        policy.Policy("sites", "row_filter", "city", branches=BRANCHES),
    ]
    ana = policy.Principal("ana", frozenset({"north"}))
    got = policy.apply_policies(silver["customers"], "customers", ana, rules)
    assert rows(got, "customer_id", "email") == [("C1", "***")] and "phone" not in got.columns
    root = policy.Principal("root", frozenset({"admins", "pii"}))
    assert rows(policy.apply_policies(silver["customers"], "customers", root, rules)) == rows(silver["customers"])


def test_what_cannot_be_applied_denies(silver):
    who = policy.Principal("ana", frozenset({"admins"}))
    unknown = [policy.Policy("customers", "tag_based", "email")]
    assert policy.apply_policies(silver["customers"], "customers", who, unknown).count() == 0
    missing = [policy.Policy("customers", "row_filter", "no_such_column", branches=BRANCHES)]
    assert policy.apply_policies(silver["customers"], "customers", who, missing).count() == 0


def test_filter_sees_values_before_the_mask(silver):
    rules = [
        policy.Policy("customers", "mask", "home_city", literal="hidden"),
        policy.Policy("customers", "row_filter", "home_city", branches=BRANCHES),
    ]
    who = policy.Principal("ana", frozenset({"north"}))
    got = policy.apply_policies(silver["customers"], "customers", who, rules)
    assert rows(got, "customer_id", "home_city") == [("C1", "hidden")]


def test_constrained_user_sees_the_same_on_every_surface(spark, silver, golden, curated):
    """Row filter, row security through the dimension, and the secured model agree."""
    grants = spark.createDataFrame([("ana", "Aville")], "principal string, city string")
    filtered = policy.row_filter(curated, "site_city", {"north"}, BRANCHES)
    secured = policy.rls(silver["rentals"], "pickup_site_id", silver["sites"], "site_id", "city", grants, "ana")
    model = semantic.fleet_model({n: golden[n] for n in ("dim_site", "dim_vehicle", "dim_customer", "fact_rental")})
    seen = semantic.secure(model, "dim_site", "city", grants, "ana").tables["fact_rental"]
    assert rows(filtered, "rental_id") == rows(secured, "rental_id") == rows(seen, "rental_id")


def test_sql_functions_agree_with_the_operators(spark, silver, curated):
    curated.createOrReplaceTempView("curated_rentals")
    silver["customers"].createOrReplaceTempView("some_customers")
    for groups in ({"north"}, {"admins", "pii"}, {"others"}):
        policy.create_sql_functions(spark, policy.Principal("x", frozenset(groups)), BRANCHES, {"pii"}, "it's ***")
        by_sql = spark.sql("SELECT rental_id FROM curated_rentals WHERE rentals_site_filter(site_city)")
        assert rows(by_sql) == rows(policy.row_filter(curated, "site_city", groups, BRANCHES), "rental_id")
        by_sql = spark.sql("SELECT mask_email(email) AS email FROM some_customers")
        assert rows(by_sql) == rows(policy.mask(silver["customers"], "email", groups, {"pii"}, "it's ***"), "email")


def test_filter_is_pushed_to_the_scan(spark, silver, tmp_path):
    silver["customers"].write.parquet(str(tmp_path / "c"))
    got = policy.row_filter(spark.read.parquet(str(tmp_path / "c")), "home_city", {"north"}, BRANCHES)
    assert "EqualTo(home_city,Aville)" in got._jdf.queryExecution().executedPlan().toString()


def test_certification(spark, silver):
    registry = governance.certify(spark, ["gold.dim_site", "gold.fact_rental"], "data team", "2024-01-01")
    assert rows(registry)[0] == ("gold.dim_site", "CERTIFIED", "data team", "2024-01-01", "gold")
    silver["sites"].write.mode("overwrite").saveAsTable("certified_sites")
    governance.tag_table(spark, "certified_sites", "data team", "2024-01-01", comment="Checked, it's fine")
    assert ("certification_status", "CERTIFIED") in rows(governance.table_tags(spark, "certified_sites"))
    assert governance.table_tags(spark, "certified_sites").count() == 4


def test_lineage_reaches_all_upstream_tables(spark):
    edges = governance.lineage(spark, medallion.pipeline_inputs())
    found = {r.src for r in governance.upstream(edges).filter("dst = 'agg_one_way_flows'").collect()}
    assert found == {
        "kpi_one_way_flows", "dim_site", "fact_rental", "rentals", "payments", "sites", "vehicles", "vehicle_classes"
    }


def test_lineage_with_a_cycle_ends(spark):
    edges = governance.lineage(spark, {"b": ["a"], "c": ["b"], "a": ["c"]})
    assert governance.upstream(edges).count() == 9
