"""Every registered query against its SQL, and the shape of its plan."""

from __future__ import annotations

import contextlib
import io

import pytest

import __spark_entry__ as entry
from checks import oracles, queries
from checks.compare import differences, duck, plain

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = queries.all_queries(), oracles.all_oracles()


@pytest.fixture(scope="module")
def con():
    return duck(DATA)


def test_every_query_has_sql_and_the_other_way_round():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    got = plain(QUERIES[name](spark, DATA).toArrow())
    assert differences(got, plain(con.execute(SQL[name]).to_arrow_table())) == []


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("stream_")])
def test_plan_has_no_cross_join_and_no_python(spark, name):
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        QUERIES[name](spark, DATA).explain()
    for node in ("CartesianProduct", "NestedLoopJoin", "Python", "Pandas"):
        assert node not in shown.getvalue(), node


def test_entry(spark):
    assert entry.entry(spark).count() == 25


def test_the_fleet_tells_its_grains_apart(spark):
    """Sites, cities and states are three grains, and some events name no vehicle: else wrong grains would agree."""
    from motorpool.sources.views import Fleet

    fleet = Fleet(spark, DATA)
    sites = fleet["sites"].selectExpr("count(*)", "count(distinct city)", "count(distinct state)").first()
    assert sites[0] > sites[1] > sites[2] > 1
    assert fleet["events"].filter("vehicle_id is null").count() > 0


@pytest.mark.parametrize("name", list(queries.ENTITIES))
def test_raw_text_repeats_rows_but_reads_each_table_once(spark, name):
    from motorpool.sources.views import Fleet

    def reads(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")

    fleet = Fleet(spark, DATA)
    raw = queries._raw_text(fleet, queries.ENTITIES[name])
    assert raw.columns[: len(fleet[name].columns)] == fleet[name].columns and "copy" not in raw.columns
    assert raw.count() == 2 * fleet[name].count() and raw.distinct().count() <= fleet[name].count()
    assert reads(raw) == reads(fleet[name]) > 0
