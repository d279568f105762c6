"""Named measures over a star schema.

A model is a set of tables, the relationships between them and the measures. ``evaluate`` turns
a question (measures, grouping columns, filters) into ordinary joins and aggregations:
dimension filters reach facts along relationships, from the one side to the many side only.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorpool.functions import money, states
from motorpool.functions.money import safe_div
from motorpool.functions.states import Aggregate
from motorpool.lazy import LazyTables
from motorpool.operators import policy
from motorpool.operators.joins import keep
from motorpool.plans.lattice import Cuboid, smallest


@dataclass(frozen=True)
class Relationship:
    """Many rows of ``fact`` belong to one row of ``dim``."""

    name: str
    fact: str
    fact_key: str
    dim: str
    dim_key: str
    active: bool = True


Part = tuple[str, Aggregate]


@dataclass(frozen=True)
class Measure:
    """A named result: aggregates over tables, combined into one value.

    ``parts`` are ``(table, aggregate)`` pairs. Parts on different tables are aggregated apart
    and meet on the grouping columns, so no side multiplies the other.
    """

    name: str
    parts: tuple[Part, ...]
    combine: Callable[..., Column] = lambda value: value
    display: Callable[[Column], Column] = money.display_number


@dataclass(frozen=True)
class Model:
    """``cuboids`` are stored groupings of tables; questions they can answer do not read the table."""

    tables: Mapping[str, DataFrame]
    relationships: tuple[Relationship, ...]
    measures: Mapping[str, Measure]
    cuboids: Mapping[str, Sequence[Cuboid]] = field(default_factory=dict)

    def steps(self, use: Sequence[str]) -> list[Relationship]:
        """Relationships in force; one named in ``use`` replaces its active sibling."""
        chosen = [r for r in self.relationships if r.name in use]
        unknown = set(use) - {r.name for r in chosen}
        if unknown:
            raise KeyError(f"unknown relationships: {sorted(unknown)}")
        replaced = {(r.fact, r.dim) for r in chosen}
        return chosen + [r for r in self.relationships if r.active and (r.fact, r.dim) not in replaced]

    def path(self, fact: str, dim: str, use: Sequence[str] = ()) -> list[Relationship] | None:
        """Shortest chain of relationships from a fact to a dimension, or None."""
        steps = self.steps(use)
        queue: deque[tuple[str, list[Relationship]]] = deque([(fact, [])])
        seen = {fact}
        while queue:
            at, chain = queue.popleft()
            if at == dim:
                return chain
            for r in steps:
                if r.fact == at and r.dim not in seen:
                    seen.add(r.dim)
                    queue.append((r.dim, [*chain, r]))
        return None


class NoPathError(ValueError):
    """A table was grouped or filtered by a column it has no relationship to."""


def _split(column: str) -> tuple[str, str]:
    table, _, name = column.partition(".")
    return table, name


def _flat(table: str, column: str) -> str:
    return f"{table}__{column}"


def star(
    model: Model, table: str, columns: Sequence[str], use: Sequence[str] = (), rows: DataFrame | None = None
) -> DataFrame:
    """A table, or ``rows`` in its place, with the named dimension columns (``dim.column``) joined on.

    Each dimension is joined once, reduced to its key and the columns in use. Rows without a
    dimension row are kept, with nulls. Joined columns are called ``dim__column``.
    """
    df = model.tables[table] if rows is None else rows
    needed: dict[str, set[str]] = {}
    links: dict[str, Relationship] = {}
    for column in columns:
        dim, name = _split(column)
        if dim == table:
            df = df.withColumn(_flat(table, name), F.col(name))
            continue
        chain = model.path(table, dim, use)
        if chain is None:
            raise NoPathError(f"{table} has no relationship to {dim}")
        needed.setdefault(dim, set()).add(name)
        for before, r in zip([None, *chain], chain):
            links.setdefault(r.dim, r)
            if before is not None:
                needed.setdefault(before.dim, set()).add(r.fact_key)
    for dim, r in links.items():
        source = r.fact_key if r.fact == table else _flat(r.fact, r.fact_key)
        names = sorted(needed.get(dim, set()))
        side = model.tables[dim].select(
            F.col(r.dim_key).alias(f"_key_{dim}"), *[F.col(n).alias(_flat(dim, n)) for n in names]
        )
        df = df.join(side, F.col(source) == F.col(f"_key_{dim}"), "left").drop(f"_key_{dim}")
    return df


Filters = Mapping[str, object]


def _condition(column: str, wanted: object) -> Column:
    """A filter is a value, a list of values, or a function from column to condition."""
    col = F.col(_flat(*_split(column)))
    if callable(wanted):
        return wanted(col)
    if isinstance(wanted, (list, tuple, set, frozenset)):
        return col.isin(*wanted)
    return col == F.lit(wanted)


def context(
    model: Model, table: str, by: Sequence[str], filters: Filters, use: Sequence[str] = (), rows: DataFrame | None = None
) -> DataFrame:
    """The rows of ``table``, or of ``rows`` in its place, in the filter context.

    As in any star model a filter on a table that ``table`` is not related to leaves it alone,
    while grouping by an unrelated column is an error. A filter on a table or column that the
    model does not have is an error too.
    """
    for c in filters:
        known = model.tables.get(_split(c)[0])
        if known is None or _split(c)[1] not in known.columns:
            raise KeyError(f"the model has no column {c}")
    reaching = _reaching(model, table, filters, use)
    df = star(model, table, list(dict.fromkeys([*by, *reaching])), use, rows)
    for column, wanted in reaching.items():
        df = df.filter(_condition(column, wanted))
    return df


def _reaching(model: Model, table: str, filters: Filters, use: Sequence[str]) -> Filters:
    return {c: v for c, v in filters.items() if model.path(table, _split(c)[0], use) is not None}


def _own_columns(model: Model, table: str, columns: Sequence[str], use: Sequence[str]) -> list[str]:
    """The columns of ``table`` through which dimension columns are reached."""
    found = []
    for column in columns:
        dim, name = _split(column)
        chain = model.path(table, dim, use)
        found.append(chain[0].fact_key if chain else name)
    return found


def grouped(
    model: Model, table: str, by: Sequence[str], aggregates: Mapping[str, Aggregate], filters: Filters, use: Sequence[str]
) -> DataFrame:
    """Aggregates of one table per group, from the smallest stored grouping that can answer, else from its rows."""
    keys = [_flat(*_split(c)) for c in by]
    columns = _own_columns(model, table, [*by, *_reaching(model, table, filters, use)], use)
    stored = smallest(model.cuboids.get(table, ()), columns, list(aggregates.values()))
    if stored is not None:
        return states.merged(context(model, table, by, filters, use, stored.data), keys, aggregates)
    rows = context(model, table, by, filters, use)
    return rows.groupBy(*keys).agg(*[a().alias(n) for n, a in aggregates.items()])


def evaluate(
    model: Model,
    measures: Sequence[str],
    by: Sequence[str] = (),
    filters: Filters | None = None,
    use: Sequence[str] = (),
) -> DataFrame:
    """Measures per group.

    ``by`` and the keys of ``filters`` are ``table.column``; ``use`` names inactive
    relationships to follow. The result has one column per grouping column (by its own name)
    and one per measure. Groups in which every measure is blank are left out.
    """
    model.steps(use)  # refuses unknown names before anything is planned
    filters = filters or {}
    chosen = [model.measures[m] for m in measures]
    leading = {m.parts[0][0] for m in chosen}
    per_table: dict[str, dict[str, Aggregate]] = {}
    for m in chosen:
        for i, (table, aggregate) in enumerate(m.parts):
            per_table.setdefault(table, {})[f"{m.name}#{i}"] = aggregate

    whole: list[DataFrame] = []
    coarser: list[tuple[list[str], DataFrame]] = []
    for table, aggregates in per_table.items():
        reach = [c for c in by if model.path(table, _split(c)[0], use) is not None]
        if reach != list(by) and table in leading:
            raise NoPathError(f"{table} has no relationship to {sorted(set(by) - set(reach))}")
        part = grouped(model, table, reach, aggregates, filters, use)
        if reach == list(by):
            whole.append(part)
        else:
            coarser.append((reach, part))
    keys = [_flat(*_split(c)) for c in by]
    joined = _meet(whole, keys)
    for reach, part in coarser:
        joined = _attach(joined, part, [_flat(*_split(c)) for c in reach])

    values = [m.combine(*[F.col(f"`{m.name}#{i}`") for i in range(len(m.parts))]).alias(m.name) for m in chosen]
    out = joined.select(*[F.col(k).alias(_split(c)[1]) for k, c in zip(keys, by)], *values)
    return out.dropna("all", subset=list(measures)) if by else out


def _attach(groups: DataFrame, part: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Give each group the values of a part that knows only some of the grouping columns.

    Such a part is not filtered by the others, so its value repeats: the sites in a ratio by
    vehicle class are all sites in context.
    """
    own = [c for c in part.columns if c not in keys]
    if not keys:
        return groups.withColumns({c: part.select(f"`{c}`").scalar() for c in own})
    renamed = part.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return groups.join(renamed, same, "left").drop(*[f"_{k}" for k in keys])


def _meet(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Put grouped results side by side.

    Every part has one row per group and columns of its own, so after a union each group holds
    at most one value per column. Null groups meet like any other.
    """
    if len(parts) == 1:
        return parts[0]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    own = [c for c in stacked.columns if c not in keys]
    return stacked.groupBy(*keys).agg(*[F.max(f"`{c}`").alias(c) for c in own])


def formatted(model: Model, answer: DataFrame) -> DataFrame:
    """The answer as text for a reader, each measure in its own format."""
    shown = {c: model.measures[c].display(F.col(f"`{c}`")) for c in answer.columns if c in model.measures}
    return answer.withColumns(shown)


def secure(model: Model, dim: str, column: str, mapping: DataFrame, user: str) -> Model:
    """The model as one user sees it.

    The dimension is cut to the rows granted to the user and every fact follows along its
    relationships. A table with no path to the dimension shows nothing, unless it is itself a
    dimension above the facts (it then carries no measures of its own).
    """
    above = {r.dim for r in model.relationships} - {r.fact for r in model.relationships}

    def visible() -> DataFrame:
        return policy.allowed_dim(model.tables[dim], column, mapping, user)

    def seen(name: str) -> DataFrame:
        if name == dim:
            return visible()
        df = model.tables[name]
        if name in above:
            return df
        chain = model.path(name, dim)
        return _follow(model, df, chain, visible()) if chain else policy.deny(df)

    def cut(name: str, stored: Cuboid) -> Cuboid | None:
        if name == dim:
            return replace(stored, data=policy.allowed_dim(stored.data, column, mapping, user)) if column in stored.keys else None
        chain = model.path(name, dim)
        if not chain or chain[0].fact_key not in stored.keys:
            return None
        return replace(stored, data=_follow(model, stored.data, chain, visible()))

    cuboids = {name: [c for c in (cut(name, s) for s in own) if c] for name, own in model.cuboids.items()}
    return replace(model, tables=LazyTables({name: partial(seen, name) for name in model.tables}), cuboids=cuboids)


def _follow(model: Model, df: DataFrame, chain: Sequence[Relationship], visible: DataFrame) -> DataFrame:
    """Semi-join a fact to the visible rows at the end of a chain of relationships."""
    *inner, last = chain
    keys = visible.select(F.col(last.dim_key).alias(last.fact_key))
    for r, after in zip(reversed(inner), reversed(chain)):
        holder = keep(model.tables[r.dim], keys, after.fact_key)
        keys = holder.select(F.col(r.dim_key).alias(r.fact_key))
    return keep(df, keys, chain[0].fact_key)


# --- the fleet model --------------------------------------------------------------------------

# Relationships of the fleet model (many side, its key, one side, its key).
RELATIONSHIPS = (
    Relationship("rel_rental_site", "fact_rental", "pickup_site_id", "dim_site", "site_id"),
    Relationship("rel_rental_vehicle", "fact_rental", "vehicle_id", "dim_vehicle", "vehicle_id"),
    Relationship("rel_rental_customer", "fact_rental", "customer_id", "dim_customer", "customer_id"),
    Relationship("rel_vehicle_site", "dim_vehicle", "current_site_id", "dim_site", "site_id"),
    Relationship("rel_revenue_site", "agg_revenue_by_site", "pickup_site_id", "dim_site", "site_id"),
    Relationship(
        "rel_utilization_site", "agg_fleet_utilization_by_site_month", "pickup_site_id", "dim_site", "site_id"
    ),
    Relationship("rel_idle_site", "agg_idle_vehicles_by_site", "current_site_id", "dim_site", "site_id"),
    Relationship("rel_maintenance_site", "agg_maintenance_cost_by_site", "site_id", "dim_site", "site_id"),
    Relationship("rel_oneway_pickup_site", "agg_one_way_flows", "pickup_site_id", "dim_site", "site_id"),
    Relationship(
        "rel_oneway_return_site", "agg_one_way_flows", "return_site_id", "dim_site", "site_id", active=False
    ),
)

HIERARCHIES = {
    "Geography": ("dim_site.state", "dim_site.city", "dim_site.site_name"),
    "Fleet": ("dim_vehicle.category", "dim_vehicle.class_name", "dim_vehicle.vehicle_id"),
}


Display = Callable[[Column], Column]
WHOLE_USD: Display = money.display_usd
CENTS: Display = partial(money.display_usd, digits=2)
PERCENT: Display = money.display_percent
COUNT: Display = money.display_number
TENTHS: Display = partial(money.display_number, digits=1)


def _of(table: str) -> Callable[..., Measure]:
    def measure(name: str, aggregate: Aggregate, display: Display = COUNT) -> Measure:
        return Measure(name, ((table, aggregate),), display=display)

    return measure


def _ratio(name: str, top: Part, bottom: Part, display: Display = PERCENT) -> Measure:
    return Measure(name, (top, bottom), safe_div, display)


def _fleet_measures() -> dict[str, Measure]:
    rental, revenue, month = _of("fact_rental"), _of("agg_revenue_by_site"), _of("agg_revenue_by_site_month")
    use, idle = _of("agg_fleet_utilization_by_site_month"), _of("agg_idle_vehicles_by_site")
    flows, repair, tele = (
        _of("agg_one_way_flows"),
        _of("agg_maintenance_cost_by_site"),
        _of("agg_telematics_freshness"),
    )
    rows: Part = ("fact_rental", states.row_count())
    # A count over no rows is blank, not zero.
    one_way: Part = ("fact_rental", states.count_where("is_one_way"))
    earned: Part = ("fact_rental", states.usd("revenue_usd"))
    available = states.total("fleet_days", lambda: F.col("fleet_size") * F.col("days_in_month"))
    listed = [
        Measure("Total Rentals", (rows,)),
        Measure("Total Revenue", (earned,), display=WHOLE_USD),
        _ratio("Revenue per Rental", earned, rows, CENTS),
        _ratio("Revenue per Site", earned, ("dim_site", states.distinct("site_id")), WHOLE_USD),
        rental("Average Rental Duration", states.mean("rental_days"), TENTHS),
        rental("Total Miles Driven", states.total("miles_driven")),
        rental("Active Vehicles", states.distinct("vehicle_id")),
        Measure("One-Way Rentals", (one_way,)),
        _ratio("One-Way Rental %", one_way, rows),
        revenue("Site Revenue", states.usd("total_revenue_usd"), WHOLE_USD),
        month("Monthly Revenue", states.usd("total_revenue_usd"), WHOLE_USD),
        _ratio(
            "Fleet Utilization %",
            ("agg_fleet_utilization_by_site_month", states.total("total_rented_days")),
            ("agg_fleet_utilization_by_site_month", available),
        ),
        idle("Idle Vehicle Count", states.total("idle_vehicles")),
        _ratio(
            "Idle Vehicle %",
            ("agg_idle_vehicles_by_site", states.total("idle_vehicles")),
            ("agg_idle_vehicles_by_site", states.total("vehicles_at_site")),
        ),
        flows("One-Way Trips", states.total("one_way_trips")),
        repair("Maintenance Cost", states.usd("total_maintenance_cost_usd"), WHOLE_USD),
        tele("Telematics Vehicles Tracked", states.distinct("vehicle_id")),
        tele("Avg Telematics Freshness (min)", states.mean("minutes_since_last_snapshot"), TENTHS),
        tele("Max Telematics Idle (min)", states.largest("max_idle_minutes"), TENTHS),
        repair("Labor Cost", states.usd("total_labor_cost_usd"), WHOLE_USD),
        repair("Parts Cost", states.usd("total_parts_cost_usd"), WHOLE_USD),
        repair("Maintenance Events", states.total("maintenance_events")),
        idle("Fleet Size", states.total("vehicles_at_site")),
        idle("Vehicles In Maintenance", states.total("maintenance_vehicles")),
        flows("One-Way Revenue", states.usd("one_way_revenue_usd"), WHOLE_USD),
        use("Rented Vehicle-Days", states.total("total_rented_days")),
        revenue("Avg Revenue per Rental", states.mean("avg_revenue_per_rental_usd"), CENTS),
    ]
    return {m.name: m for m in listed}


MEASURES = _fleet_measures()


def fleet_model(tables: Mapping[str, DataFrame], cuboids: Mapping[str, Sequence[Cuboid]] | None = None) -> Model:
    """The fleet model over gold and aggregate tables, by their names, and stored groupings of them."""
    present = set(tables)
    links = tuple(r for r in RELATIONSHIPS if {r.fact, r.dim} <= present)
    usable = {n: m for n, m in MEASURES.items() if {t for t, _ in m.parts} <= present}
    return Model(tables, links, usable, cuboids or {})
