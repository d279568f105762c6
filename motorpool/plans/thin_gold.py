"""The rental aggregates of the report layer, from stored states, kept up batch by batch.

All of them are sums over rentals by site, other site, direction and month, so one small table of states answers them.
A batch of new, changed and withdrawn rentals becomes signed states: what the batch brings is added, what it replaces is
taken back. Nothing is rebuilt, and each batch is one commit of the states and of the rentals they stand for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motorpool.functions import calendar, states
from motorpool.operators import rollups
from motorpool.operators.gold import PICKUP_ROLE, RETURN_ROLE
from motorpool.operators.joins import enrich_geo, role_dim, site_geo
from motorpool.plans.lattice import Cuboid, Store, build
from motorpool.sources.commits import CommittedTable, ConflictError

KEYS = ("pickup_site_id", "return_site_id", "is_one_way", "rental_month")
COUNTED = states.count_of("rental_id")
REVENUE, MEAN_REVENUE = states.usd_rounded("revenue_usd"), states.usd_mean("revenue_usd")
DAYS, MEAN_DAYS = states.total("rental_days"), states.mean("rental_days")
AGGREGATES = (states.row_count(), COUNTED, REVENUE, MEAN_REVENUE, states.usd("revenue_usd"), DAYS, MEAN_DAYS)
# What a fact has to have for these states.
COLUMNS = ("rental_id", "pickup_site_id", "return_site_id", "is_one_way", "pickup_ts", "revenue_usd", "rental_days")


def by_month(fact: DataFrame) -> DataFrame:
    return fact.select(*COLUMNS).withColumn("rental_month", calendar.month_of("pickup_ts"))


def rental_months(fact: DataFrame, store: Store) -> Cuboid:
    """Rentals by both sites, direction and month. ``fact`` has one row per rental."""
    return build(by_month(fact), KEYS, AGGREGATES, store)


def revenue_by_site(stored: DataFrame, geo: DataFrame) -> DataFrame:
    totals = states.merged(
        stored,
        ["pickup_site_id"],
        {"total_rentals": COUNTED, "total_revenue_usd": REVENUE, "avg_revenue_per_rental_usd": MEAN_REVENUE, "avg_rental_days": MEAN_DAYS},
    )
    return enrich_geo(totals.withColumn("avg_rental_days", F.round("avg_rental_days", 1)), geo, "pickup_site_id")


def revenue_by_site_month(stored: DataFrame, sites: DataFrame) -> DataFrame:
    totals = states.merged(stored, ["pickup_site_id", "rental_month"], {"total_rentals": COUNTED, "total_revenue_usd": REVENUE})
    named = totals.join(role_dim(sites, PICKUP_ROLE), "pickup_site_id", "left").withColumnRenamed("rental_month", "revenue_month")
    return named.select(*PICKUP_ROLE.values(), "revenue_month", "total_rentals", "total_revenue_usd")


def fleet_utilization(stored: DataFrame, vehicles: DataFrame, geo: DataFrame, site_col: str = "current_site_id") -> DataFrame:
    rented = states.merged(stored, ["pickup_site_id", "rental_month"], {"total_rentals": COUNTED, "total_rented_days": DAYS})
    return rollups.utilization(rented, vehicles, geo, site_col)


def one_way_flows(stored: DataFrame, sites: DataFrame) -> DataFrame:
    totals = states.merged(
        stored.where("is_one_way"), ["pickup_site_id", "return_site_id"], {"one_way_trips": COUNTED, "one_way_revenue_usd": REVENUE}
    )
    ends = ["pickup_site_id", "pickup_site_name", "pickup_city", *RETURN_ROLE.values()]
    named = totals.join(role_dim(sites, PICKUP_ROLE), "pickup_site_id", "left").join(role_dim(sites, RETURN_ROLE), "return_site_id", "left")
    return rollups.agg_one_way_flows(named.select(*ends, "one_way_trips", "one_way_revenue_usd"), site_geo(sites))


def tables(stored: DataFrame, sites: DataFrame, vehicles: DataFrame) -> dict[str, DataFrame]:
    """The four rental aggregates by name; ``sites`` and ``vehicles`` are dimension tables."""
    geo = site_geo(sites)
    return {
        "agg_revenue_by_site": revenue_by_site(stored, geo),
        "agg_revenue_by_site_month": revenue_by_site_month(stored, sites),
        "agg_fleet_utilization_by_site_month": fleet_utilization(stored, vehicles, geo),
        "agg_one_way_flows": one_way_flows(stored, sites),
    }


class Maintained:
    """States of all rentals under ``path``, kept up from batches of changed rentals.

    ``schema`` gives the types of COLUMNS in their order. A batch that a source has committed before is passed over.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark = spark
        empty = spark.createDataFrame([], schema)
        if tuple(empty.columns) != COLUMNS:
            raise ValueError(f"the rentals need the columns {COLUMNS}")
        signed = self._signed(empty.withColumns({"_sign": F.lit(1)}))
        shape = lambda df: ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
        schemas = {"rentals": f"{schema}, _deleted boolean, _batch long", "states": shape(signed)}
        self.table = CommittedTable(spark, path, schemas, times={"rentals": "pickup_ts"})

    @staticmethod
    def _signed(rows: DataFrame) -> DataFrame:
        dated = rows.withColumn("rental_month", calendar.month_of("pickup_ts"))
        return states.signed(dated, KEYS, AGGREGATES, F.col("_sign"))

    def current(self, ids: DataFrame | None = None) -> DataFrame:
        """The newest version of every rental, or of those whose ids are given; withdrawn ones are marked."""
        rows = self.table.read("rentals")
        if ids is not None:
            rows = rows.join(ids, "rental_id", "left_semi")
        newest = Window.partitionBy("rental_id").orderBy(F.desc("_batch"))
        return rows.withColumn("_place", F.row_number().over(newest)).where("_place = 1").drop("_place")

    def apply(self, changes: DataFrame, source: str, batch: int, order: Sequence[str] = ()) -> bool:
        """Take over a batch: the rentals as they are now, with ``deleted`` true for those withdrawn.

        Of several rows for a rental the last one by ``order`` counts (then the largest one). Rentals without an id are
        passed over. A batch the source has applied before changes nothing: False. If another commit comes in between,
        the batch is worked out again on top of it.
        """
        deleted = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in changes.columns else F.lit(False)
        last = Window.partitionBy("rental_id").orderBy(*[F.desc(c) for c in (*order, *COLUMNS)])
        rows = changes.where("rental_id IS NOT NULL").withColumn("_place", F.row_number().over(last)).where("_place = 1")
        while True:
            now = self.table.snapshot()
            if now.batches.get(source, -1) >= batch:
                return False
            numbered = rows.select(*COLUMNS, deleted.alias("_deleted"), F.lit(now.version + 1).cast("long").alias("_batch"))
            came = self.table.write("rentals", numbered)
            # The states are made of what was written: the batch may not be the same when it is read again.
            new = self.table.stored(came, "rentals")
            old = self.current(new.select("rental_id"))
            signed = new.withColumn("_sign", F.lit(1)).unionByName(old.withColumn("_sign", F.lit(-1))).where("NOT _deleted")
            try:
                return self.table.admit([*came, *self.table.write("states", self._signed(signed))], source, batch, on=now.version)
            except ConflictError:
                continue

    def states(self) -> DataFrame:
        """The states of all rentals in force, as :func:`rental_months` would store them."""
        return _settled(self.table.read("states"))

    def compact(self) -> None:
        """Replace the states of all batches by their sum."""
        old = self.table.snapshot().of("states")
        if len(old) > 1:
            self.table.swap("states", old, self.table.write("states", self.states().coalesce(1)))


def _settled(deltas: DataFrame) -> DataFrame:
    """Signed states added up; groups without rentals are gone, sums without a value are null."""
    total = states.regrouped(deltas, KEYS, AGGREGATES).where("rows <> 0")
    return total.withColumns(
        {s: F.when(F.col(n) > 0, F.col(s)) for s, n in (("exact_revenue_usd", "count_revenue_usd"), ("sum_rental_days", "count_rental_days"))}
    )
