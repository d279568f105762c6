"""The questions the report asks, as queries on the fleet model."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorpool.functions import calendar
from motorpool.functions.money import exact_sum, safe_div
from motorpool.operators.rollups import drill
from motorpool.plans.semantic import Filters, Model, context, evaluate

CARDS = (
    "Total Revenue",
    "Fleet Utilization %",
    "Idle Vehicle Count",
    "Maintenance Cost",
    "Telematics Vehicles Tracked",
)


def kpi_cards(model: Model, measures: Sequence[str] = CARDS, filters: Filters | None = None) -> DataFrame:
    """The headline numbers, one row."""
    return evaluate(model, measures, filters=filters)


def revenue_by_city(model: Model, filters: Filters | None = None) -> DataFrame:
    return evaluate(model, ["Site Revenue"], by=["dim_site.city"], filters=filters)


def site_map(model: Model, filters: Filters | None = None) -> DataFrame:
    """Revenue per city with the middle of the city's sites."""
    places = model.tables["dim_site"].groupBy("city").agg(
        F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude")
    )
    return revenue_by_city(model, filters).join(places, "city", "left")


def hierarchy(
    model: Model, table: str, levels: Sequence[str], measure: str, filters: Filters | None = None
) -> DataFrame:
    """One measure at every depth of a hierarchy of ``table.column`` levels, in the context of ``filters``.

    A measure of several parts is combined at each depth; all of them must be of ``table``.
    """
    m = model.measures[measure]
    others = {t for t, _ in m.parts if t != table}
    if others:
        raise ValueError(f"{measure} also reads {sorted(others)} and cannot be drilled along {table}")
    rows = context(model, table, levels, filters or {})
    names = [c.replace(".", "__") for c in levels]
    parts = [f"_part{i}" for i in range(len(m.parts))]
    opened = drill(rows, names, {p: aggregate for p, (_, aggregate) in zip(parts, m.parts)})
    opened = opened.withColumn(measure, m.combine(*[F.col(p) for p in parts])).drop(*parts)
    return opened.withColumnsRenamed({n: c.split(".")[1] for n, c in zip(names, levels)})


def revenue_decomposition(model: Model, filters: Filters | None = None) -> DataFrame:
    """Total revenue by state, then city, then vehicle class."""
    levels = ["dim_site.state", "dim_site.city", "dim_vehicle.class_name"]
    return hierarchy(model, "fact_rental", levels, "Total Revenue", filters)


def forecast_linear(
    series: DataFrame,
    by: Sequence[str],
    month: str,
    value: str,
    horizon: int = 3,
    z: float = 1.96,
) -> DataFrame:
    """Straight-line trend per series, carried ``horizon`` months past its last month.

    Rows are summed to one value per series (``by``) and month first, so the table may be of a
    finer grain. The band is ``z`` residual standard deviations around the line, with two degrees
    of freedom spent on it; a series of fewer than three months has a line at best and no band.
    Months are numbered through all years, counted from 2000 to keep the numbers small.
    """
    y = F.col("_y")
    fitted = (
        series.groupBy(*by, month)
        .agg(exact_sum(value).cast("double").alias("_y"))
        .withColumn("_t", (calendar.month_number(month) - 12 * 2000).cast("double"))
        .groupBy(*by)
        .agg(
            F.count(y).alias("months"),
            F.max(month).alias("_last"),
            F.max("_t").alias("_end"),
            F.regr_slope(y, "_t").alias("slope"),
            F.regr_intercept(y, "_t").alias("intercept"),
            F.regr_r2(y, "_t").alias("r2"),
            F.regr_syy(y, "_t").alias("_syy"),
        )
    )
    unexplained = F.greatest(F.lit(0.0), F.col("_syy") * (1 - F.col("r2")))
    sigma = F.sqrt(safe_div(unexplained, F.when(F.col("months") > 2, F.col("months") - 2)))
    steps = fitted.withColumn("_sigma", sigma).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))
    )
    line: Column = F.col("intercept") + F.col("slope") * (F.col("_end") + F.col("step"))
    return steps.select(
        *by,
        "step",
        F.add_months("_last", F.col("step")).alias("month"),
        line.alias("forecast"),
        (line - z * F.col("_sigma")).alias("lower"),
        (line + z * F.col("_sigma")).alias("upper"),
        "slope",
        "r2",
    )


# Smoothing of level, trend and season that are tried for each series.
GRID = tuple(product((0.2, 0.5, 0.8), (0.05, 0.2), (0.1, 0.4)))


def forecast_smoothed(
    series: DataFrame,
    by: Sequence[str],
    month: str,
    value: str,
    horizon: int = 3,
    season: int = 12,
    z: float = 1.96,
    grid: Sequence[tuple[float, float, float]] = GRID,
) -> DataFrame:
    """Level, trend and additive season of each series, smoothed month by month and carried ``horizon`` months on.

    Rows are summed to one value per series (``by``) and month first; months without a row count as zero. Level, trend
    and season start from the first two seasons, and every later month moves them on. Each setting of ``grid`` is tried,
    and the one with the smallest squared one-step errors (the first of equals) is used. The band is ``z`` times the
    root of their mean, wider with the step. Series of two seasons or less get no rows. All values of a series, one for
    each month, are one array: the fold over it needs no Python and no join.
    """
    months = calendar.month_number(month).cast("int")
    totals = series.groupBy(*by, months.alias("_m")).agg(exact_sum(value).cast("double").alias("_y"))
    whole = totals.where("_m IS NOT NULL").groupBy(*by).agg(
        F.min("_m").alias("_from"), F.max("_m").alias("_to"), F.map_from_entries(F.collect_list(F.struct("_m", "_y"))).alias("_of")
    )
    filled = F.transform(F.sequence("_from", "_to"), lambda m: F.coalesce(F.try_element_at("_of", m), F.lit(0.0)))
    rows = whole.select(*by, "_to", filled.alias("_y")).where(F.size("_y") > 2 * season)

    def total(array: Column) -> Column:
        return F.aggregate(array, F.lit(0.0), lambda a, v: a + v)

    first, second = (total(F.slice("_y", 1 + k * season, season)) / F.lit(float(season)) for k in (0, 1))
    settings = F.array(*[
        F.struct(F.lit(i).alias("i"), *[F.lit(float(v)).alias(n) for n, v in zip(("a", "b", "g"), s)]) for i, s in enumerate(grid)
    ])
    tried = rows.withColumns({"_level": first, "_trend": (second - first) / F.lit(float(season)), "_p": F.explode(settings)})
    start = F.struct(
        F.col("_level").alias("level"),
        F.col("_trend").alias("trend"),
        F.transform(F.slice("_y", 1, season), lambda v: v - F.col("_level")).alias("season"),
        F.lit(0.0).alias("error"),
    )
    p = F.col("_p")

    def move(s: Column, y: Column) -> Column:
        old = F.get(s["season"], F.lit(0))
        level = p["a"] * (y - old) + (1 - p["a"]) * (s["level"] + s["trend"])
        miss = y - (s["level"] + s["trend"] + old)
        return F.struct(
            level.alias("level"),
            (p["b"] * (level - s["level"]) + (1 - p["b"]) * s["trend"]).alias("trend"),
            F.concat(F.slice(s["season"], 2, season - 1), F.array(p["g"] * (y - level) + (1 - p["g"]) * old)).alias("season"),
            (s["error"] + miss * miss).alias("error"),
        )

    later = F.slice("_y", season + 1, F.size("_y") - season)
    fitted = tried.withColumn("_s", F.aggregate(later, start, move)).withColumn("_n", F.size("_y") - season)
    best = fitted.groupBy(*by).agg(F.min_by(F.struct("_s", "_n", "_to", "_p"), F.struct("_s.error", "_p.i")).alias("_best"))
    steps = best.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    state, step = F.col("_best._s"), F.col("step")
    line = state["level"] + step * state["trend"] + F.get(state["season"], (step - 1) % season)
    band = z * F.sqrt(state["error"] / F.col("_best._n")) * F.sqrt(step.cast("double"))
    return steps.select(
        *by,
        "step",
        F.add_months(F.lit("2000-01-01").cast("date"), F.col("_best._to") - (12 * 2000 + 1) + step).alias("month"),
        line.alias("forecast"),
        (line - band).alias("lower"),
        (line + band).alias("upper"),
        F.col("_best._p.a").alias("alpha"),
        F.col("_best._p.b").alias("beta"),
        F.col("_best._p.g").alias("gamma"),
    )
