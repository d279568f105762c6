"""Every registered query: ``(spark, data directory) -> DataFrame`` over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motorpool.functions import calendar
from motorpool.functions.money import exact_sum, price_columns
from motorpool.functions.text import formatted_key
from motorpool.lazy import LazyTables
from motorpool.operators import cleaning, filters, gold, graph, joins, policy, quality, ranking, rollups
from motorpool.plans import medallion, report, semantic, thin_gold
from motorpool.plans.lattice import Cuboid
from motorpool.schemas import ENTITIES, EVENT, RENTALS, VEHICLES, Entity
from motorpool.session import configure, shared_dir
from motorpool.sources import events as feed
from motorpool.sources import tables
from motorpool.sources.commits import CommittedTable
from motorpool.sources.views import Fleet, event_columns
from motorpool.streaming import incidents as runs
from motorpool.streaming import jobs, presence, rules

Query = Callable[[SparkSession, str], DataFrame]

# A moment after the last event of the test data.
AS_OF = datetime(2024, 1, 31)
SPIKE = (datetime(2024, 1, 10, 12, 0), datetime(2024, 1, 12, 12, 0))
ORIGIN = (47.6062, -122.3321)

_QUERIES: dict[str, Query] = {}


def query(build: Callable[[Fleet], DataFrame]) -> Callable[[Fleet], DataFrame]:
    def run(spark: SparkSession, directory: str) -> DataFrame:
        return build(Fleet(configure(spark), directory))

    _QUERIES[build.__name__] = run
    return build


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def text_dates(df: DataFrame, *columns: str) -> DataFrame:
    """Dates as ISO text, which every engine prints alike."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def _fact(f: Fleet, *columns: str) -> DataFrame:
    return medallion.fact(f, columns or gold.FACT_RENTAL)


def _geo(f: Fleet) -> DataFrame:
    return joins.site_geo(f["sites"])


SITE_FACT = ("rental_id", *gold.PICKUP_ROLE.values(), "pickup_ts", "revenue_usd", "rental_days")
LEAN_FACT = ("rental_id", "pickup_site_id", "pickup_ts", "revenue_usd", "rental_days")
DAYS_FACT = ("rental_id", "pickup_site_id", "pickup_ts", "rental_days")
CLASS_FACT = ("rental_id", "vehicle_class_id", "class_name", "category", "rental_days")
MEASURED_FACT = (
    "rental_id",
    "customer_id",
    "vehicle_id",
    "pickup_site_id",
    "return_site_id",
    "rental_days",
    "miles_driven",
    "is_one_way",
    "revenue_usd",
)
FLOW_FACT = (
    "rental_id",
    "pickup_site_id",
    "pickup_site_name",
    "pickup_city",
    *gold.RETURN_ROLE.values(),
    "is_one_way",
    "revenue_usd",
)


# --- sources ----------------------------------------------------------------------------------


@query
def dim_site(f: Fleet) -> DataFrame:
    return text_dates(gold.dim_site(f["sites"]), "opened_date")


@query
def dim_customer(f: Fleet) -> DataFrame:
    return text_dates(gold.dim_customer(f["customers"]), "join_date")


@query
def json_mapping(f: Fleet) -> DataFrame:
    mapping = {"k": ("$.k", "int"), "k_text": ("$.k", "string"), "missing": ("$.absent", "long")}
    return feed.apply_json_mapping(f.base("events"), "props", mapping, keep=["event_id"])


@query
def bronze_ingest(f: Fleet) -> DataFrame:
    audited = cleaning.with_audit(f["maintenance"].select("maintenance_id", "vehicle_id"), "shop", "raw", "batch-1", AS_OF)
    return audited.withColumn("_ingested_at", F.col("_ingested_at").cast("timestamp_ntz"))


@query
def retention(f: Fleet) -> DataFrame:
    kept = filters.retain(f["events"], "ts", 14, F.lit(AS_OF).cast("timestamp_ntz"))
    return kept.select("event_id", "vehicle_id", "ts")


@query
def hot_set(f: Fleet) -> DataFrame:
    return filters.hot_set(f["events"], "ts", F.lit(AS_OF).cast("timestamp_ntz")).select("event_id", "ts")


@query
def manifest(f: Fleet) -> DataFrame:
    return tables.manifest(f)


# --- cleaning, projections, filters -----------------------------------------------------------


@query
def dedup_by_key(f: Fleet) -> DataFrame:
    return cleaning.dedup(
        f.base("lineitem"),
        ["l_orderkey", "l_linenumber"],
        [
            F.col("l_shipdate").desc_nulls_last(),
            *[
                F.col(c).asc_nulls_last()
                for c in (
                    "l_partkey",
                    "l_suppkey",
                    "l_quantity",
                    "l_extendedprice",
                    "l_discount",
                    "l_tax",
                    "l_returnflag",
                    "l_linestatus",
                )
            ],
        ],
    )


@query
def null_key_filter(f: Fleet) -> DataFrame:
    """One rental per vehicle, the latest; rentals without a vehicle drop out."""
    rows = f["rentals"].select("vehicle_id", "rental_id", "pickup_ts")
    return cleaning.dedup(rows, "vehicle_id", [F.col("pickup_ts").desc_nulls_last()])


@query
def cast_projection(f: Fleet) -> DataFrame:
    """Values that arrive as text: whole numbers with a decimal point, codes that do not parse."""
    raw = f.base("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_quantity").cast("string").alias("quantity"),
        F.col("l_extendedprice").cast("string").alias("price"),
        F.col("l_returnflag").alias("flag"),
        F.date_format("l_shipdate", calendar.ISO_UTC).alias("shipped"),
    )
    cast = cleaning.cast_columns(raw, {"quantity": "int", "price": "double", "flag": "int", "shipped": "timestamp"})
    return cast.withColumn("shipped", F.col("shipped").cast("timestamp_ntz"))


@query
def text_normalisation(f: Fleet) -> DataFrame:
    padded = f.base("customer").select(
        "c_custkey",
        F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("name"),
        F.concat(F.lit(" "), "c_mktsegment").alias("segment"),
        F.concat("c_mktsegment", F.lit("  ")).alias("segment_low"),
    )
    return cleaning.normalize_text(padded, {"name": "trim", "segment": "upper", "segment_low": "lower"})


@query
def one_way_rentals(f: Fleet) -> DataFrame:
    return filters.one_way(f["rentals"]).select("rental_id", "pickup_site_id", "return_site_id")


@query
def odometer_over_limit(f: Fleet) -> DataFrame:
    return filters.threshold(f["events"], "odometer_miles", ">", 75000).select("event_id", "odometer_miles")


@query
def fault_code_present(f: Fleet) -> DataFrame:
    return filters.with_value(f["events"], "fault_code").select("event_id", "fault_code")


@query
def events_in_range(f: Fleet) -> DataFrame:
    return filters.in_range(f["events"], "ts", *SPIKE).select("event_id", "ts")


@query
def site_geo(f: Fleet) -> DataFrame:
    return joins.site_geo(f["sites"], coords_only=True)


# --- scalar functions -------------------------------------------------------------------------


@query
def rental_durations(f: Fleet) -> DataFrame:
    start, end = F.col("pickup_ts"), F.col("return_ts")
    return f["rentals"].select(
        "rental_id",
        calendar.rental_days_calendar(start, end).alias("days_calendar"),
        calendar.rental_days_elapsed(start, end).alias("days_elapsed"),
        calendar.days_in_month(start).alias("month_length"),
        calendar.format_iso(start).alias("pickup_iso"),
        formatted_key("RN", 8, F.col("rental_id")).alias("rental_key"),
    )


@query
def rental_prices(f: Fleet) -> DataFrame:
    rates = f["vehicle_classes"].select("vehicle_class_id", "daily_base_rate_usd")
    rate = joins.lookup(f["vehicles"].select("vehicle_id", "vehicle_class_id"), rates, "vehicle_class_id")
    closed = f["rentals"].filter("status = 'closed'")
    priced = joins.lookup(closed, rate, "vehicle_id", spread_nulls_by="rental_id")
    days = calendar.rental_days_elapsed(F.col("pickup_ts"), F.col("return_ts"))
    daily = F.coalesce("daily_base_rate_usd", F.lit(50.0))
    return priced.select(
        "rental_id",
        *[c.alias(n) for n, c in price_columns(daily, days, F.col("is_one_way")).items()],
    )


# --- star schema and KPIs ---------------------------------------------------------------------


@query
def dim_vehicle(f: Fleet) -> DataFrame:
    return text_dates(gold.dim_vehicle(f["vehicles"], f["vehicle_classes"]), "acquired_date")


@query
def payments_by_rental(f: Fleet) -> DataFrame:
    return gold.payments_by_rental(f["payments"])


@query
def fact_rental(f: Fleet) -> DataFrame:
    return _fact(f)


@query
def rentals_curated(f: Fleet) -> DataFrame:
    return gold.rentals_curated(f["rentals"], f["sites"])


@query
def kpi_revenue_by_site(f: Fleet) -> DataFrame:
    return gold.kpi_revenue_by_site(_fact(f, *SITE_FACT))


@query
def rented_days_by_class(f: Fleet) -> DataFrame:
    return gold.rented_days_by_class(_fact(f, *CLASS_FACT))


@query
def fleet_size_by_class(f: Fleet) -> DataFrame:
    return gold.fleet_size(f["vehicles"], "vehicle_class_id")


@query
def fleet_size_by_site(f: Fleet) -> DataFrame:
    return gold.fleet_size(f["vehicles"], "home_site_id")


@query
def kpi_fleet_utilization(f: Fleet) -> DataFrame:
    return gold.kpi_fleet_utilization(_fact(f, *CLASS_FACT), f["vehicles"])


@query
def kpi_one_way_flows(f: Fleet) -> DataFrame:
    return gold.kpi_one_way_flows(_fact(f, *FLOW_FACT))


@query
def kpi_maintenance_cost(f: Fleet) -> DataFrame:
    return gold.kpi_maintenance_cost(f["maintenance"], f["sites"])


@query
def maintenance_cost_by_vehicle(f: Fleet) -> DataFrame:
    return gold.maintenance_totals(f["maintenance"], by="vehicle_id")


@query
def payment_revenue_by_site(f: Fleet) -> DataFrame:
    """Payments carry the pickup site of their rental, as landed payments do."""
    site = f["rentals"].select("rental_id", "pickup_site_id")
    return gold.payment_revenue(f["payments"].join(site, "rental_id"))


# --- report-ready aggregates ------------------------------------------------------------------


@query
def agg_revenue_by_site(f: Fleet) -> DataFrame:
    return rollups.agg_revenue_by_site(_fact(f, *LEAN_FACT), _geo(f))


@query
def agg_revenue_by_site_month(f: Fleet) -> DataFrame:
    return text_dates(rollups.agg_revenue_by_site_month(_fact(f, *SITE_FACT)), "revenue_month")


@query
def agg_fleet_utilization_by_site_month(f: Fleet) -> DataFrame:
    agg = rollups.agg_fleet_utilization_by_site_month(_fact(f, *DAYS_FACT), f["vehicles"], _geo(f))
    return text_dates(agg, "rental_month")


@query
def fleet_utilization_prorated(f: Fleet) -> DataFrame:
    agg = rollups.fleet_utilization_prorated(_fact(f, *DAYS_FACT), f["vehicles"], _geo(f), "home_site_id")
    return text_dates(agg, "rental_month")


@query
def agg_idle_vehicles_by_site(f: Fleet) -> DataFrame:
    return rollups.agg_idle_vehicles_by_site(f["vehicles"], _geo(f))


@query
def agg_one_way_flows(f: Fleet) -> DataFrame:
    return rollups.agg_one_way_flows(gold.kpi_one_way_flows(_fact(f, *FLOW_FACT)), _geo(f))


@query
def agg_maintenance_cost_by_site(f: Fleet) -> DataFrame:
    kpi = gold.kpi_maintenance_cost(f["maintenance"], f["sites"])
    return rollups.agg_maintenance_cost_by_site(kpi, f["sites"])


@query
def agg_telematics_freshness(f: Fleet) -> DataFrame:
    return rollups.agg_telematics_freshness(f["telematics"], AS_OF)


@query
def spike_summary(f: Fleet) -> DataFrame:
    return rollups.spike_summary(f["events"], *SPIKE)


@query
def ingest_status(f: Fleet) -> DataFrame:
    return rollups.ingest_status(f["events"], "ts")


@query
def spike_check(f: Fleet) -> DataFrame:
    return rollups.spike_check(f["events"])


# --- measures and report ----------------------------------------------------------------------


def _kept(f: Fleet, df: DataFrame) -> DataFrame:
    """The rows stored in the shared folder and read again."""
    path = f"{_work_dir(f.spark)}/stored"
    df.write.parquet(path)
    return f.spark.read.schema(df.schema).parquet(path)


def _rental_months(f: Fleet) -> Cuboid:
    return thin_gold.rental_months(_fact(f, *thin_gold.COLUMNS), lambda df: _kept(f, df))


def _model(f: Fleet, *, stored: bool = False) -> semantic.Model:
    """The fleet model over views; each question builds and reads only what it needs.

    With ``stored`` rentals are grouped by site and month once, and all that can be derived from that is.
    """

    def maintenance() -> DataFrame:
        return gold.kpi_maintenance_cost(f["maintenance"], f["sites"])

    def vehicles() -> DataFrame:
        return gold.dim_vehicle(f["vehicles"], f["vehicle_classes"])

    derived: dict[str, DataFrame] = {}
    cuboids: dict[str, list[Cuboid]] = {}
    if stored:
        months = _rental_months(f)
        derived = thin_gold.tables(months.data, gold.dim_site(f["sites"]), vehicles())
        cuboids = {"fact_rental": [months]}
    return semantic.fleet_model(
        LazyTables(
            {
                "dim_site": lambda: gold.dim_site(f["sites"]),
                "dim_vehicle": vehicles,
                "dim_customer": lambda: gold.dim_customer(f["customers"]),
                "fact_rental": lambda: _fact(f, *MEASURED_FACT),
                "agg_revenue_by_site": lambda: rollups.agg_revenue_by_site(_fact(f, *LEAN_FACT), _geo(f)),
                "agg_revenue_by_site_month": lambda: rollups.agg_revenue_by_site_month(_fact(f, *SITE_FACT)),
                "agg_fleet_utilization_by_site_month": lambda: rollups.agg_fleet_utilization_by_site_month(
                    _fact(f, *DAYS_FACT), vehicles(), _geo(f)
                ),
                "agg_idle_vehicles_by_site": lambda: rollups.agg_idle_vehicles_by_site(vehicles(), _geo(f)),
                "agg_one_way_flows": lambda: rollups.agg_one_way_flows(
                    gold.kpi_one_way_flows(_fact(f, *FLOW_FACT)), _geo(f)
                ),
                "agg_maintenance_cost_by_site": lambda: rollups.agg_maintenance_cost_by_site(maintenance(), f["sites"]),
                "agg_telematics_freshness": lambda: rollups.agg_telematics_freshness(f["telematics"], AS_OF),
            }
            | {name: partial(derived.__getitem__, name) for name in derived}
        ),
        cuboids,
    )


def _plain(df: DataFrame) -> DataFrame:
    """Measure names as identifiers: ``One-Way Rental %`` becomes ``one_way_rental_pct``."""
    names = {
        c: c.lower().replace("%", "pct").replace(" (min)", "_min").replace("-", "_").replace(" ", "_") for c in df.columns
    }
    return df.withColumnsRenamed(names)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


RENTAL_MEASURES = (
    "Total Rentals",
    "Total Revenue",
    "Revenue per Rental",
    "Revenue per Site",
    "Average Rental Duration",
    "Total Miles Driven",
    "Active Vehicles",
    "One-Way Rentals",
    "One-Way Rental %",
)


@query
def measures_rental_by_state(f: Fleet) -> DataFrame:
    return _plain(_rounded(semantic.evaluate(_model(f), RENTAL_MEASURES, by=["dim_site.state"]), 4))


@query
def measures_rental_by_class_sliced(f: Fleet) -> DataFrame:
    """Grouped by a vehicle attribute while a slicer on sites is set."""
    measures = [m for m in RENTAL_MEASURES if m != "Revenue per Site"]
    sliced = semantic.evaluate(
        _model(f), measures, by=["dim_vehicle.class_name"], filters={"dim_site.state": ["ASIA", "EUROPE"]}
    )
    return _plain(_rounded(sliced, 4))


@query
def revenue_per_site_by_class(f: Fleet) -> DataFrame:
    """A ratio whose lower part the grouping does not reach: all sites in the slicer count."""
    ratio = semantic.evaluate(
        _model(f),
        ["Revenue per Site"],
        by=["dim_vehicle.class_name", "dim_customer.loyalty_tier"],
        filters={"dim_site.state": ["ASIA", "EUROPE"]},
    )
    return _plain(_rounded(ratio, 4))


@query
def measures_rental_by_tier(f: Fleet) -> DataFrame:
    by = ["dim_customer.loyalty_tier", "dim_site.state"]
    return _plain(_rounded(semantic.evaluate(_model(f), ["Total Rentals", "Total Revenue"], by=by), 4))


SITE_MEASURES = (
    "Site Revenue",
    "Avg Revenue per Rental",
    "Idle Vehicle Count",
    "Idle Vehicle %",
    "Fleet Size",
    "Vehicles In Maintenance",
    "Maintenance Cost",
    "Labor Cost",
    "Parts Cost",
    "Maintenance Events",
    "One-Way Trips",
    "One-Way Revenue",
    "Fleet Utilization %",
    "Rented Vehicle-Days",
)


@query
def measures_site_by_state(f: Fleet) -> DataFrame:
    return _plain(_rounded(semantic.evaluate(_model(f, stored=True), SITE_MEASURES, by=["dim_site.state"]), 4))


@query
def measures_monthly_revenue(f: Fleet) -> DataFrame:
    by = ["agg_revenue_by_site_month.revenue_month"]
    monthly = semantic.evaluate(_model(f), ["Monthly Revenue"], by=by)
    return _plain(text_dates(_rounded(monthly, 2), "revenue_month"))


@query
def measures_telematics(f: Fleet) -> DataFrame:
    names = ["Telematics Vehicles Tracked", "Avg Telematics Freshness (min)", "Max Telematics Idle (min)"]
    return _plain(_rounded(semantic.evaluate(_model(f), names), 4))


@query
def measures_one_way_by_return_site(f: Fleet) -> DataFrame:
    """The inactive relationship: trips by the site they end at."""
    by_end = semantic.evaluate(
        _model(f), ["One-Way Trips", "One-Way Revenue"], by=["dim_site.city"], use=["rel_oneway_return_site"]
    )
    return _plain(_rounded(by_end, 2))


@query
def measures_secured_by_city(f: Fleet) -> DataFrame:
    """The same measures as one user sees them: three cities granted through a mapping table."""
    model = semantic.secure(_model(f), "dim_site", "city", _grants(f), "ana")
    return _plain(_rounded(semantic.evaluate(model, ["Total Rentals", "Site Revenue"], by=["dim_site.city"]), 4))


def _grants(f: Fleet) -> DataFrame:
    """Who may see which city: each user is granted the cities of one region."""
    user = F.when(F.col("state") == "ASIA", "ana").when(F.col("state") == "EUROPE", "ben")
    return f["sites"].select(user.alias("principal"), "city").dropna()


@query
def kpi_cards(f: Fleet) -> DataFrame:
    return _plain(_rounded(report.kpi_cards(_model(f, stored=True)), 4))


SLICER = {"dim_site.state": ["ASIA", "EUROPE"]}


@query
def kpi_cards_sliced(f: Fleet) -> DataFrame:
    """The cards under a slicer; events are not related to sites and stay whole."""
    return _plain(_rounded(report.kpi_cards(_model(f, stored=True), filters=SLICER), 4))


@query
def revenue_decomposition_sliced(f: Fleet) -> DataFrame:
    return _plain(_rounded(report.revenue_decomposition(_model(f), filters=SLICER), 2))


@query
def revenue_per_rental_by_geography(f: Fleet) -> DataFrame:
    """A ratio drilled: parts are added up at each depth, then divided."""
    levels = semantic.HIERARCHIES["Geography"]
    return _plain(_rounded(report.hierarchy(_model(f), "fact_rental", levels, "Revenue per Rental"), 4))


@query
def sites_by_revenue_in_order(f: Fleet) -> DataFrame:
    """Sites from the highest revenue down; the place in the result is a column, so that the order is compared."""
    kpi = gold.kpi_revenue_by_site(_fact(f, *SITE_FACT)).select("pickup_site_id", "total_revenue_usd")
    return _placed(ranking.ordered(kpi, "total_revenue_usd", ["pickup_site_id"]))


@query
def revenue_by_month_in_order(f: Fleet) -> DataFrame:
    """Monthly revenue ordered by site and month."""
    monthly = rollups.agg_revenue_by_site_month(_fact(f, *SITE_FACT)).select("pickup_site_id", "revenue_month", "total_rentals")
    return text_dates(_placed(monthly.orderBy("pickup_site_id", "revenue_month")), "revenue_month")


@query
def formatted_measures(f: Fleet) -> DataFrame:
    """Measures as a reader sees them, each in its own format."""
    model = _model(f)
    names = ["Total Rentals", "Total Revenue", "Revenue per Rental", "One-Way Rental %"]
    return _plain(semantic.formatted(model, semantic.evaluate(model, names, by=["dim_site.state"])))


@query
def idle_vehicles_in_order(f: Fleet) -> DataFrame:
    return _placed(ranking.ordered(graph.idle_vehicles_by_site(_graph(f)), "idle_vehicles", ["site_name"]))


def _placed(df: DataFrame) -> DataFrame:
    """Rows with their position in the order in which the result holds them."""
    place = Window.orderBy(F.monotonically_increasing_id())
    return df.withColumn("position", F.row_number().over(place).cast("long"))


@query
def revenue_by_city(f: Fleet) -> DataFrame:
    return _plain(_rounded(report.revenue_by_city(_model(f)), 2))


@query
def site_map(f: Fleet) -> DataFrame:
    return _plain(_rounded(report.site_map(_model(f)), 4))


@query
def revenue_decomposition(f: Fleet) -> DataFrame:
    return _plain(_rounded(report.revenue_decomposition(_model(f)), 2))


@query
def rentals_by_geography(f: Fleet) -> DataFrame:
    levels = semantic.HIERARCHIES["Geography"]
    return _plain(report.hierarchy(_model(f), "fact_rental", levels, "Total Rentals"))


@query
def rentals_by_fleet_hierarchy(f: Fleet) -> DataFrame:
    levels = semantic.HIERARCHIES["Fleet"]
    return _plain(report.hierarchy(_model(f), "fact_rental", levels, "Total Rentals"))


@query
def vehicles_by_geography(f: Fleet) -> DataFrame:
    """A distinct count drilled: a vehicle rented in two cities counts once in their state."""
    levels = semantic.HIERARCHIES["Geography"]
    return _plain(report.hierarchy(_model(f), "fact_rental", levels, "Active Vehicles"))


# --- aggregates kept up batch by batch --------------------------------------------------------

STATE_FACT = "rental_id long, pickup_site_id int, return_site_id int, is_one_way boolean, pickup_ts timestamp_ntz, revenue_usd double, rental_days int"


def _maintained(f: Fleet) -> thin_gold.Maintained:
    """All rentals in four batches: a third of them wrong or missing at first, corrected later, and some withdrawn."""
    fact = _kept(f, _fact(f, *thin_gold.COLUMNS))
    kept = thin_gold.Maintained(f.spark, f"{_work_dir(f.spark)}/thin", STATE_FACT)
    hashed = F.pmod(F.xxhash64("rental_id"), F.lit(9))
    wrong = {"revenue_usd": F.col("revenue_usd") * 2 + 0.01, "pickup_site_id": F.lit(0), "rental_days": F.col("rental_days") + 40}
    first = fact.where(hashed != 1).withColumns({c: F.when(hashed == 2, v).otherwise(F.col(c)) for c, v in wrong.items()})
    kept.apply(first, "rentals", 0)
    corrected = fact.where(hashed.isin(1, 2))
    kept.apply(corrected, "rentals", 1)
    kept.apply(corrected, "rentals", 1)  # delivered twice
    never = fact.where(hashed == 3).withColumn("rental_id", -F.col("rental_id") - 1)
    kept.apply(never, "rentals", 2)
    kept.apply(never.withColumn("deleted", F.lit(True)), "rentals", 3)
    return kept


@query
def maintained_revenue_by_site_month(f: Fleet) -> DataFrame:
    monthly = thin_gold.revenue_by_site_month(_maintained(f).states(), gold.dim_site(f["sites"]))
    return text_dates(monthly, "revenue_month")


@query
def maintained_one_way_flows(f: Fleet) -> DataFrame:
    kept = _maintained(f)
    kept.compact()
    return thin_gold.one_way_flows(kept.states(), gold.dim_site(f["sites"]))


@query
def committed_events(f: Fleet) -> DataFrame:
    """Events landed in weekly commits, gathered into larger files, the first two weeks expired: what each day has."""
    kept = ("event_id", "vehicle_id", "ts", "idle_minutes")
    events = f["events"].select(*kept)
    shape = ", ".join(f"{n} {t}" for n, t in events.dtypes)
    landed = CommittedTable(f.spark, f"{_work_dir(f.spark)}/events", {"events": shape}, times={"events": "ts"})
    week = F.floor((F.dayofyear("ts") - 1) / 7)
    for n in range(5):
        rows = events.where(week == n if n < 4 else week >= n)
        landed.append({"events": rows}, "feed", n)
        landed.append({"events": rows}, "feed", n)  # delivered twice
    landed.expire("events", "2024-01-15")
    landed.compact("events", 64 << 20)
    day = F.col("ts").cast("date").cast("string").alias("event_date")
    return landed.read("events").groupBy(day).agg(F.count("*").alias("events"), F.sum("idle_minutes").alias("idle_sum"))


def _forecast(f: Fleet, by: list[str]) -> DataFrame:
    series = rollups.agg_revenue_by_site_month(_fact(f, *SITE_FACT))
    trend = report.forecast_linear(series, by, "revenue_month", "total_revenue_usd")
    kept = trend.drop("slope", "r2").withColumns({c: F.round(c, 2) for c in ("forecast", "lower", "upper")})
    return text_dates(kept, "month")


@query
def revenue_forecast(f: Fleet) -> DataFrame:
    return _forecast(f, ["pickup_city"])


@query
def revenue_forecast_smoothed(f: Fleet) -> DataFrame:
    """Level, trend and season per city."""
    return _smoothed(f, ["pickup_city"])


@query
def revenue_forecast_smoothed_total(f: Fleet) -> DataFrame:
    return _smoothed(f, [])


def _smoothed(f: Fleet, by: list[str]) -> DataFrame:
    series = rollups.agg_revenue_by_site_month(_fact(f, *SITE_FACT))
    found = report.forecast_smoothed(series, by, "revenue_month", "total_revenue_usd")
    return text_dates(found.withColumns({c: F.round(c, 2) for c in ("forecast", "lower", "upper")}), "month")


@query
def revenue_forecast_total(f: Fleet) -> DataFrame:
    return _forecast(f, [])


# --- windows and ranking ----------------------------------------------------------------------


@query
def latest_snapshot(f: Fleet) -> DataFrame:
    return cleaning.latest_per(f["telematics"], "vehicle_id", "snapshot_ts").select(
        "vehicle_id", "telematics_id", "snapshot_ts", "odometer_miles", "idle_minutes"
    )


@query
def new_since(f: Fleet) -> DataFrame:
    seen = F.lit(datetime(2024, 1, 20)).cast("timestamp_ntz")
    return filters.new_since(f["events"], "ts", seen).select("event_id", "ts")


@query
def reading_change(f: Fleet) -> DataFrame:
    events = f["events"].select("event_id", "vehicle_id", "ts", "odometer_miles")
    return ranking.change(events, "vehicle_id", "ts", "odometer_miles", tiebreak="event_id")


@query
def top_one_way_flows(f: Fleet) -> DataFrame:
    flows = gold.kpi_one_way_flows(_fact(f, *FLOW_FACT)).select("pickup_site_id", "return_site_id", "one_way_trips")
    return ranking.top_k(flows, "one_way_trips", 10, keys=["pickup_site_id", "return_site_id"])


@query
def idle_site_ranking(f: Fleet) -> DataFrame:
    sites = rollups.agg_idle_vehicles_by_site(f["vehicles"], _geo(f)).select("site_name", "idle_vehicles")
    return ranking.top_k(sites, "idle_vehicles", 5, ties=True).withColumn("rank", F.col("rank").cast("long"))


@query
def top_sites_per_state(f: Fleet) -> DataFrame:
    kpi = gold.kpi_revenue_by_site(_fact(f, *SITE_FACT))
    best = ranking.top_k(kpi, "total_revenue_usd", 2, keys=["pickup_site_id"], within=["pickup_state"])
    return best.select("pickup_state", "pickup_city", "total_revenue_usd", F.col("rank").cast("long").alias("rank"))


# --- graph ------------------------------------------------------------------------------------


def _graph(f: Fleet) -> graph.FleetGraph:
    return graph.fleet_graph(f["vehicles"], f["sites"], f["rentals"])


@query
def graph_idle_vehicles_by_site(f: Fleet) -> DataFrame:
    return graph.idle_vehicles_by_site(_graph(f))


@query
def graph_one_way_paths(f: Fleet) -> DataFrame:
    return graph.one_way_paths(_graph(f))


@query
def graph_vehicles_at(f: Fleet) -> DataFrame:
    return graph.vehicles_at(_graph(f), "NATION_7")


# --- data quality -----------------------------------------------------------------------------


@query
def customers_without_rental(f: Fleet) -> DataFrame:
    lost = joins.orphans(f["customers"], "customer_id", f["rentals"], "customer_id")
    return lost.select("customer_id", "email", "home_city")


@query
def fk_resolution(f: Fleet) -> DataFrame:
    return joins.fk_resolves(f["rentals"], "vehicle_id", f["vehicles"], "vehicle_id")


@query
def fk_report(f: Fleet) -> DataFrame:
    relations = [
        ("vehicles", "vehicle_class_id", "vehicle_classes"),
        ("vehicles", "home_site_id", "sites"),
        ("vehicles", "current_site_id", "sites"),
        ("rentals", "vehicle_id", "vehicles"),
        ("rentals", "customer_id", "customers"),
        ("rentals", "pickup_site_id", "sites"),
        ("rentals", "return_site_id", "sites"),
        ("payments", "rental_id", "rentals"),
        ("maintenance", "vehicle_id", "vehicles"),
        ("maintenance", "site_id", "sites"),
        ("telematics", "vehicle_id", "vehicles"),
        ("telematics", "site_id", "sites"),
        ("reservations", "customer_id", "customers"),
        ("reservations", "vehicle_class_id", "vehicle_classes"),
        ("reservations", "pickup_site_id", "sites"),
        ("reservations", "return_site_id", "sites"),
        ("rentals", "reservation_id", "reservations"),
    ]
    keys = {
        "vehicle_classes": "vehicle_class_id",
        "sites": "site_id",
        "vehicles": "vehicle_id",
        "customers": "customer_id",
        "rentals": "rental_id",
        "reservations": "reservation_id",
    }
    return quality.check_fks(f, relations, keys)


@query
def key_uniqueness(f: Fleet) -> DataFrame:
    return quality.check_pk(f.base("lineitem"), ["l_orderkey", "l_linenumber"])


@query
def contract_rentals(f: Fleet) -> DataFrame:
    rentals = f["rentals"]
    rules_of = quality.contract_of(RENTALS, rentals.columns)
    unreturned = F.expr("status = 'closed' and return_ts is null")
    return quality.validate(rentals, {**rules_of, "closed_without_return": unreturned})


@query
def contract_vehicles(f: Fleet) -> DataFrame:
    vehicles = f["vehicles"]
    rules_of = quality.contract_of(VEHICLES, vehicles.columns)
    return quality.validate(vehicles, {**rules_of, "moved": F.expr("home_site_id <> current_site_id")})


@query
def contract_events(f: Fleet) -> DataFrame:
    """Raw text properties against the declared types of the event."""
    events = f["events"]
    raw = events.withColumn("idle_minutes", F.col("fault_code"))
    checks = {**quality.contract_of(EVENT, raw.columns), **quality.type_rules(EVENT, ["idle_minutes"])}
    return quality.validate(raw, checks)


@query
def contracts_of_all_entities(f: Fleet) -> DataFrame:
    """Every entity against its contract: missing columns, missing values, unknown codes."""
    return _by_entity(lambda e: quality.validate(f[e.name], quality.contract_of(e, f[e.name].columns)))


@query
def bronze_ingest_all(f: Fleet) -> DataFrame:
    """Every entity with its audit columns: rows, and how many carry the batch they came with."""

    def counted(e: Entity) -> DataFrame:
        audited = cleaning.with_audit(f[e.name], "shop", "raw", f"batch-{e.name}", AS_OF)
        stamped = F.count_if((F.col("_batch_id") == f"batch-{e.name}") & F.col("_ingested_at").isNotNull())
        return audited.agg(F.count("*").alias("rows"), stamped.alias("stamped"), F.max("_source_system").alias("source"))

    return _by_entity(counted)


def _raw_text(f: Fleet, e: Entity) -> DataFrame:
    """An entity as text with faults, every row twice: no key where it ends in 7, no number in 3, no date in 5."""
    view = f[e.name]
    last = F.right(F.col(e.key).cast("string"), F.lit(1))
    texts = []
    for c in view.columns:
        kind, text = e.types.get(c, "string"), F.col(c).cast("string")
        if kind == "timestamp":
            text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        if c == e.key:
            text = F.when(last != "7", text)
        elif kind in ("timestamp", "date"):
            text = F.when(last == "5", "no date").otherwise(text)
        elif kind in ("int", "long", "double"):
            text = F.when(last == "3", "n/a").otherwise(text)
        elif c in e.text:
            text = F.concat(F.lit("  "), text, F.lit(" "))
        texts.append(text.alias(c))
    # Each row is made once and then repeated: the tables are read, joined and turned into text a single time.
    twice = view.select(*texts).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return cleaning.with_audit(twice, "shop", "raw", "batch-1", AS_OF)


@query
def silver_of_all_entities(f: Fleet) -> DataFrame:
    """Faulty text of every entity cleaned: rows, and values left per column."""

    def counted(e: Entity) -> DataFrame:
        silver = cleaning.to_silver(e, _raw_text(f, e)).select(*[c for c in f[e.name].columns if c != "rental_days"])
        per_column = silver.agg(F.count("*").alias("rows"), *[F.count(c).alias(f"n_{c}") for c in silver.columns])
        pairs = [F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("values")) for c in silver.columns]
        return per_column.select("rows", F.inline(F.array(*pairs)))

    return _by_entity(counted)


def _by_entity(build: Callable[[Entity], DataFrame]) -> DataFrame:
    parts = [build(e).withColumn("entity", F.lit(e.name)) for e in ENTITIES.values()]
    return reduce(DataFrame.unionByName, parts)


@query
def layer_reconciliation(f: Fleet) -> DataFrame:
    """All payments by pickup site against all rentals of the fact."""
    site = f["rentals"].select("rental_id", "pickup_site_id")
    sides = (
        f["payments"].join(site, "rental_id").withColumnRenamed("total_amount_usd", "revenue_usd"),
        _fact(f, "rental_id", "pickup_site_id", "revenue_usd"),
    )
    measures = {
        "revenue": exact_sum("revenue_usd"),
        # The fact has unpaid rentals too, with nothing to add.
        "rentals": F.count_distinct(F.when(F.col("revenue_usd") > 0, F.col("rental_id"))),
    }
    # Each rental is rounded to cents in the fact, so totals may drift by cents.
    found = quality.reconcile(*sides, ["pickup_site_id"], measures, tolerance=0.02)
    return found.withColumns({c: F.round(c, 2) for c in ("left_total", "right_total", "difference")})


@query
def differing_rows(f: Fleet) -> DataFrame:
    """A copy of the rentals with some rows changed, one lost and one twice: found by digests of buckets."""
    left = f["rentals"].select("rental_id", "customer_id", "miles_driven")
    changed = F.when(F.col("rental_id") % 1000 == 7, F.coalesce("miles_driven", F.lit(0)) + 1).otherwise(F.col("miles_driven"))
    right = left.withColumn("miles_driven", changed)
    copies = F.expr("case rental_id when 11 then array() when 12 then array(1, 1) else array(1) end")
    right = right.withColumn("copy", F.explode(copies)).drop("copy")
    return quality.same_rows(left, right, by=["rental_id"])


@query
def one_answer_two_ways(f: Fleet) -> DataFrame:
    """Idle vehicles per site as a measure and as a graph question."""
    measured = semantic.evaluate(_model(f), ["Idle Vehicle Count"], by=["dim_site.site_name"])
    asked = graph.idle_vehicles_by_site(_graph(f))
    left = measured.withColumnRenamed("Idle Vehicle Count", "idle_vehicles").filter("idle_vehicles > 0")
    return quality.compare(left, asked)


@query
def one_way_flag_check(f: Fleet) -> DataFrame:
    """The stored flag against the flag recomputed from the two sites."""
    stored = f["rentals"].select("rental_id", "is_one_way")
    recomputed = f["rentals"].select("rental_id", F.expr("pickup_site_id <> return_site_id").alias("is_one_way"))
    return quality.compare(stored, recomputed)


@query
def pii_columns(f: Fleet) -> DataFrame:
    return quality.classify_pii(f.base("documents"), min_ratio=0.05)


@query
def pii_customers(f: Fleet) -> DataFrame:
    return quality.classify_pii(f["customers"])


# --- policies ---------------------------------------------------------------------------------

BRANCHES = (("all_sites", policy.ALL), ("managers_asia", "ASIA-2"), ("managers_europe", "EUROPE-1"))


VISITORS = ("all_sites", "managers_asia", "managers_europe", "guests")


def _visible(f: Fleet, conditions: dict[str, Column], df: DataFrame) -> DataFrame:
    """Rows visible to each principal, counted in one pass."""
    counted = df.agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])
    pairs = [F.struct(F.lit(n).alias("principal"), F.col(n).alias("visible_rentals")) for n in conditions]
    return counted.select(F.inline(F.array(*pairs)))


@query
def row_filter_manager(f: Fleet) -> DataFrame:
    curated = gold.rentals_curated(f["rentals"], f["sites"])
    seen = policy.row_filter(curated, "site_city", {"managers_asia", "managers_europe"}, BRANCHES)
    return seen.select("rental_id", "site_city", "status")


@query
def row_filter_admin(f: Fleet) -> DataFrame:
    curated = gold.rentals_curated(f["rentals"], f["sites"])
    seen = policy.row_filter(curated, "site_city", {"managers_europe", "all_sites"}, BRANCHES)
    return seen.select("rental_id", "site_city")


@query
def row_filter_outsider(f: Fleet) -> DataFrame:
    """Rentals each of several principals sees: a guest sees none."""
    curated = gold.rentals_curated(f["rentals"], f["sites"]).select("rental_id", "site_city")
    return _visible(f, {g: policy.row_predicate(F.col("site_city"), {g}, BRANCHES) for g in VISITORS}, curated)


@query
def masked_customers(f: Fleet) -> DataFrame:
    masked = policy.mask(f["customers"], "email", {"analysts"}, {"pii_readers"})
    return masked.select("customer_id", "email", "loyalty_tier")


@query
def hidden_columns(f: Fleet) -> DataFrame:
    return text_dates(policy.hide(f["customers"], ["email", "phone"]), "join_date")


@query
def rls_by_mapping(f: Fleet) -> DataFrame:
    seen = policy.rls(f["rentals"], "pickup_site_id", f["sites"], "site_id", "city", _grants(f), "ben")
    return seen.select("rental_id", "pickup_site_id", "is_one_way")


@query
def policy_set(f: Fleet) -> DataFrame:
    """Row filter, mask and hidden column together, for one principal."""
    rules_ = [
        policy.Policy("customers", "row_filter", "home_city", branches=BRANCHES),
        policy.Policy("Customers", "mask", "Email", allowed=("pii_readers",), literal="***"),
        policy.Policy("customers", "hide", "PHONE"),
        policy.Policy("rentals", "unheard_of", "status"),
    ]
    who = policy.Principal("cem", frozenset({"managers_asia"}))
    return text_dates(policy.apply_policies(f["customers"], "customers", who, rules_), "join_date")


@query
def sql_functions(f: Fleet) -> DataFrame:
    """The row filter and the mask as SQL functions, for a principal who sees one city and no addresses."""
    who = policy.Principal("cem", frozenset({"managers_asia"}))
    policy.create_sql_functions(f.spark, who, (("managers_asia", "ASIA-0"),), {"privacy"})
    seen = "SELECT customer_id, mask_email(email) AS email, home_city FROM {customers} WHERE rentals_site_filter(home_city)"
    return f.spark.sql(seen, customers=f["customers"])


@query
def policy_set_denied(f: Fleet) -> DataFrame:
    """What is left under a rule that can be applied, and under rules that cannot: those deny the table."""
    who = policy.Principal("cem", frozenset({"all_sites"}))
    kinds = {
        "applied": policy.Policy("rentals", "mask", "STATUS"),
        "unknown kind": policy.Policy("rentals", "unheard_of", "status"),
        "absent column": policy.Policy("rentals", "hide", "phone"),
    }
    parts = [
        policy.apply_policies(f["rentals"].select("rental_id", "status"), "rentals", who, [rule]).select(
            F.lit(name).alias("rule"), "rental_id", "status"
        )
        for name, rule in kinds.items()
    ]
    seen = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return seen.groupBy("rule", "status").agg(F.count("*").alias("visible_rentals"))


# --- alerts on a table ------------------------------------------------------------------------


def _placed_events(f: Fleet) -> DataFrame:
    places = f["sites"].select("site_id", "latitude", "longitude")
    return joins.lookup(f["events"], places, "site_id")


@query
def idle_alerts(f: Fleet) -> DataFrame:
    return rules.idle_alerts(_placed_events(f))


@query
def fault_alerts(f: Fleet) -> DataFrame:
    return rules.fault_alerts(f["events"])


@query
def overdue_alerts(f: Fleet) -> DataFrame:
    return rules.overdue_alerts(f["events"])


@query
def rule_alerts(f: Fleet) -> DataFrame:
    return rules.evaluate_rules(f["events"])


@query
def spike_windows(f: Fleet) -> DataFrame:
    return jobs.spike_windows(f["events"], "10 minutes", min_avg_idle=45.0)


GAP_MINUTES, ELEVATED_MINUTES = 720, 90


@query
def incidents(f: Fleet) -> DataFrame:
    """Elevated readings of a vehicle less than twelve hours apart, as one incident."""
    return runs.incidents(f["events"], GAP_MINUTES, ELEVATED_MINUTES)


# --- streams: the event table replayed file by file, then read back ----------------------------


def _work_dir(spark: SparkSession) -> str:
    """A fresh directory for the files and the state of one stream."""
    return f"{shared_dir(spark)}/motorpool/{uuid.uuid4()}"


def _event_stream(f: Fleet) -> DataFrame:
    source = f.base("events")
    # As a pattern the path may name a single file as well as a directory of files.
    stream = feed.stream_table(f.spark, f"{f.directory}/{{events}}.parquet", source.schema)
    return event_columns(stream).withColumn("ts", F.col("ts").cast("timestamp"))


def _stored(f: Fleet, path: str) -> DataFrame:
    return _zoneless(feed.read_flow(f.spark, path))


def _zoneless(df: DataFrame) -> DataFrame:
    times = [c for c, t in df.dtypes if t == "timestamp"]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})


def _run(f: Fleet, stream: DataFrame) -> DataFrame:
    work = _work_dir(f.spark)
    feed.append_flow(stream, f"{work}/out", f"{work}/checkpoint").awaitTermination()
    return _stored(f, f"{work}/out")


@query
def stream_telematics_curated(f: Fleet) -> DataFrame:
    stream = _event_stream(f).withColumnsRenamed({"event_id": "telematics_id", "ts": "snapshot_ts"})
    places = f["sites"].select("site_id", "latitude", "longitude")
    return _run(f, jobs.telematics_curated(joins.lookup(stream, places, "site_id")))


@query
def stream_idle_alerts(f: Fleet) -> DataFrame:
    places = f["sites"].select("site_id", "latitude", "longitude")
    return _run(f, rules.idle_alerts(joins.lookup(_event_stream(f), places, "site_id")))


@query
def stream_fault_alerts(f: Fleet) -> DataFrame:
    return _run(f, rules.fault_alerts(_event_stream(f)))


@query
def stream_overdue_alerts(f: Fleet) -> DataFrame:
    return _run(f, rules.overdue_alerts(_event_stream(f)))


@query
def stream_rule_alerts(f: Fleet) -> DataFrame:
    work = _work_dir(f.spark)
    alerts = rules.evaluate_rules(_event_stream(f))
    jobs.write_alerts(alerts, f"{work}/alerts", f"{work}/checkpoint").awaitTermination()
    return _stored(f, f"{work}/alerts")


@query
def stream_work_orders(f: Fleet) -> DataFrame:
    work = _work_dir(f.spark)
    alerts = rules.evaluate_rules(_event_stream(f))
    jobs.write_alerts(alerts, f"{work}/alerts", f"{work}/checkpoint").awaitTermination()
    return rules.work_orders(_stored(f, f"{work}/alerts"))


@query
def stream_spike_windows(f: Fleet) -> DataFrame:
    work = _work_dir(f.spark)
    windows = jobs.spike_windows(_event_stream(f), "1 hour", delay="10 minutes")
    feed.upsert_flow(windows, f"{work}/out", f"{work}/checkpoint").awaitTermination()
    return _zoneless(feed.read_latest(f.spark, f"{work}/out", "window_start"))


@query
def stream_dedup_events(f: Fleet) -> DataFrame:
    """Every event delivered twice, stored once."""
    twice = _event_stream(f).union(_event_stream(f)).select("event_id", "vehicle_id", "ts", "odometer_miles")
    return _run(f, jobs.dedup_events(twice, "60 days"))


@query
def stream_landed_events(f: Fleet) -> DataFrame:
    work = _work_dir(f.spark)
    feed.land_events(_event_stream(f), f"{work}/out", f"{work}/checkpoint").awaitTermination()
    landed = _stored(f, f"{work}/out")
    per_day = landed.groupBy(F.col("event_date").cast("string").alias("event_date"))
    return per_day.agg(
        F.count("*").alias("events"),
        F.count("ingested_at").alias("stamped"),
        F.sum("odometer_miles").alias("odometer_sum"),
    )


@query
def stream_enriched_events(f: Fleet) -> DataFrame:
    enriched = jobs.enrich_events(_event_stream(f), f["vehicles"], f["sites"], ORIGIN)
    return _run(
        f, enriched.select("event_id", "vehicle_id", "fleet_site_id", "site_latitude", "site_longitude", "vehicle_known")
    )


@query
def stream_incidents(f: Fleet) -> DataFrame:
    """The incidents that are over when the newest event has come."""
    return _run(f, runs.stream_incidents(_event_stream(f), GAP_MINUTES, "10 minutes", ELEVATED_MINUTES))


@query
def stream_presence(f: Fleet) -> DataFrame:
    """Readings in order with the one before, and vehicles silent for four hours."""
    return _run(f, presence.presence(_event_stream(f), 240, "10 minutes"))
