"""SQL for every registered query, written apart from the library.

``VIEWS`` are the fleet views in SQL; each oracle names the views it reads.
"""

from __future__ import annotations

PRICE = "CAST(l_extendedprice AS DECIMAL(12,2))"
OUT = "24 * (1 + o_orderkey % 13) + o_orderkey % 48 - 12"

VIEWS = {
    "sites": """
        SELECT n_nationkey AS site_id, 'ST' || n_nationkey AS site_code, n_name AS site_name, r_name || '-' || (n_nationkey % 3) AS city,
               r_name AS state, CAST(n_nationkey * 7 - 90 AS DOUBLE) AS latitude,
               CAST(n_nationkey * 14 - 180 AS DOUBLE) AS longitude, n_nationkey = 0 AS is_hq,
               40 + n_nationkey * 5 AS parking_capacity,
               CAST(DATE '2015-01-01' + CAST(n_nationkey * 30 AS INTEGER) AS DATE) AS opened_date
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "classes": """
        SELECT p_type AS vehicle_class_id, p_type AS class_name,
               CASE WHEN p_type IN ('LARGE', 'PROMO') THEN 'SUV' ELSE 'Car' END AS category,
               min(p_retailprice) AS daily_base_rate_usd,
               CASE WHEN p_type IN ('LARGE', 'PROMO') THEN 7 ELSE 5 END AS seats, p_type = 'ECONOMY' AS is_ev
        FROM part GROUP BY p_type""",
    "vehicles": """
        SELECT p_partkey AS vehicle_id, 'VIN' || p_partkey AS vin, p_type AS vehicle_class_id, p_brand AS make,
               p_name AS model, CAST(2019 + p_partkey % 6 AS INTEGER) AS model_year,
               split_part(p_name, ' ', 1) AS color, 'LP' || p_partkey AS license_plate,
               CAST(p_partkey % 25 AS INTEGER) AS home_site_id,
               CAST(CASE WHEN p_size % 4 = 0 THEN (p_partkey + p_size) % 25 ELSE p_partkey % 25 END AS INTEGER)
                 AS current_site_id,
               CASE p_size % 10 WHEN 0 THEN 'idle' WHEN 1 THEN 'maintenance' WHEN 2 THEN 'rented'
                 WHEN 3 THEN 'rented' WHEN 4 THEN 'rented' ELSE 'available' END AS status,
               (p_partkey * 37) % 90000 AS odometer_miles,
               CAST(DATE '2019-01-01' + CAST(p_partkey % 1800 AS INTEGER) AS DATE) AS acquired_date
        FROM part""",
    "customers": """
        SELECT c_custkey AS customer_id, split_part(c_name, '#', 1) AS first_name,
               split_part(c_name, '#', 2) AS last_name, lower(c_name) || '@example.com' AS email,
               '+1-555-' || (100 + c_custkey % 900) || '-' || (1000 + c_custkey % 9000) AS phone,
               c_mktsegment AS loyalty_tier, r_name || '-' || (n_nationkey % 3) AS home_city, r_name AS home_state,
               CAST(DATE '2018-01-01' + CAST(c_custkey % 2400 AS INTEGER) AS DATE) AS join_date
        FROM customer LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey""",
    "rentals": f"""
        SELECT o_orderkey AS rental_id, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey END AS reservation_id,
               o_custkey AS customer_id, vehicle_id, c_nationkey AS pickup_site_id,
               CAST(CASE WHEN o_orderkey % 100 < 18 THEN (c_nationkey + 1 + o_orderkey % 24) % 25
                 ELSE c_nationkey END AS INTEGER) AS return_site_id,
               o_orderdate AS pickup_ts, o_orderdate + to_days(CAST(1 + o_orderkey % 13 AS INTEGER)) AS planned_return_ts,
               CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_hours(CAST({OUT} AS INTEGER)) END AS return_ts,
               2000 + o_orderkey % 83000 AS odometer_out,
               CASE WHEN o_orderstatus <> 'O' THEN 40 + (o_orderkey * 31) % 1760 END AS miles_driven,
               o_orderkey % 100 < 18 AS is_one_way,
               CASE WHEN o_orderstatus <> 'O' THEN 'closed' ELSE 'open' END AS status,
               CASE WHEN o_orderstatus <> 'O' THEN CAST(greatest(1, date_diff('day', CAST(o_orderdate AS DATE),
                 CAST(o_orderdate + to_hours(CAST({OUT} AS INTEGER)) AS DATE))) AS INTEGER) END AS rental_days
        FROM orders JOIN customer ON o_custkey = c_custkey
        LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS vehicle_id FROM lineitem GROUP BY l_orderkey)
          ON l_orderkey = o_orderkey""",
    "reservations": """
        SELECT o_orderkey AS reservation_id, o_custkey AS customer_id,
               CASE WHEN o_orderkey % 53 <> 0 THEN ['ECONOMY', 'LARGE', 'PROMO', 'SMALL', 'STANDARD', 'MEDIUM'][1 + o_orderkey % 6]
                 ELSE 'NONE' END AS vehicle_class_id,
               CAST(o_custkey % 25 AS INTEGER) AS pickup_site_id, CAST(o_orderkey % 25 AS INTEGER) AS return_site_id,
               o_orderdate - to_days(CAST(1 + o_orderkey % 40 AS INTEGER)) AS reserved_at,
               CAST(o_orderdate AS DATE) AS pickup_date,
               CAST(CAST(o_orderdate AS DATE) + CAST(1 + o_orderkey % 13 AS INTEGER) AS DATE) AS planned_return_date,
               CASE WHEN o_orderkey % 19 = 0 THEN 'noshow' WHEN o_orderkey % 17 = 0 THEN 'cancelled'
                 WHEN o_orderstatus = 'O' THEN 'booked' ELSE 'fulfilled' END AS status
        FROM orders WHERE o_orderkey % 7 <> 0""",
    "payments": f"""
        SELECT l_orderkey || '-' || l_linenumber AS payment_id, l_orderkey AS rental_id, o_custkey AS customer_id,
               {PRICE} * (1 - CAST(l_discount AS DECIMAL(4,2))) AS base_amount_usd,
               CAST(CASE WHEN l_orderkey % 100 < 18 THEN 75 ELSE 0 END AS DECIMAL(5,2)) AS one_way_fee_usd,
               {PRICE} * CAST(l_tax AS DECIMAL(4,2)) AS taxes_fees_usd, 'USD' AS currency, l_shipdate AS payment_ts,
               CASE WHEN l_returnflag = 'R' THEN 'refunded' ELSE 'captured' END AS status,
               {PRICE} * (1 - CAST(l_discount AS DECIMAL(4,2)))
                 + CAST(CASE WHEN l_orderkey % 100 < 18 THEN 75 ELSE 0 END AS DECIMAL(5,2))
                 + {PRICE} * CAST(l_tax AS DECIMAL(4,2)) AS total_amount_usd
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'O'""",
    "maintenance": f"""
        SELECT l_orderkey || '-' || l_linenumber AS maintenance_id, l_partkey AS vehicle_id, s_nationkey AS site_id,
               {PRICE} * CAST(l_discount AS DECIMAL(4,2)) AS labor_cost_usd,
               {PRICE} * CAST(l_tax AS DECIMAL(4,2)) AS parts_cost_usd, l_shipdate AS opened_ts,
               CASE WHEN l_linestatus = 'O' THEN 'open' ELSE 'closed' END AS status,
               {PRICE} * CAST(l_discount AS DECIMAL(4,2)) + {PRICE} * CAST(l_tax AS DECIMAL(4,2)) AS total_cost_usd
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R'""",
    "tele": """
        SELECT event_id, CASE WHEN event_id % 41 <> 0 THEN user_id % 200 END AS vehicle_id, CAST(user_id % 25 AS INTEGER) AS site_id, ts,
               CASE WHEN event_type IN ('click', 'view') THEN 'on' ELSE 'off' END AS ignition_state,
               CAST(floor(value) AS INTEGER) AS idle_minutes, (event_id * 97) % 100000 AS odometer_miles,
               CASE event_type WHEN 'error' THEN 'P0' || json_extract_string(props, '$.k')
                 WHEN 'signup' THEN '' END AS fault_code,
               CASE WHEN event_type = 'click' THEN CAST(floor(value) AS INTEGER) % 75 ELSE 0 END AS speed_mph,
               CAST(5 + event_id % 95 AS INTEGER) AS fuel_or_soc_pct, user_id % 7 = 0 AS is_spike
        FROM events""",
    "paid": """
        SELECT rental_id, sum(total_amount_usd) AS total, CAST(round(sum(total_amount_usd), 2) AS DOUBLE) AS revenue_usd,
               CAST(round(sum(base_amount_usd), 2) AS DOUBLE) AS base_amount_usd,
               CAST(round(sum(one_way_fee_usd), 2) AS DOUBLE) AS one_way_fee_usd,
               CAST(round(sum(taxes_fees_usd), 2) AS DOUBLE) AS taxes_fees_usd
        FROM payments GROUP BY rental_id""",
    "fact": """
        SELECT r.rental_id, r.reservation_id, r.customer_id, r.vehicle_id, v.vehicle_class_id, c.class_name, c.category,
               r.pickup_site_id, p.site_name AS pickup_site_name, p.city AS pickup_city, p.state AS pickup_state,
               r.return_site_id, q.site_name AS return_site_name, q.city AS return_city,
               r.pickup_ts, r.return_ts, r.rental_days, r.miles_driven, r.is_one_way, r.status,
               coalesce(m.revenue_usd, 0.0) AS revenue_usd, m.base_amount_usd, m.one_way_fee_usd, m.taxes_fees_usd
        FROM rentals r LEFT JOIN paid m ON r.rental_id = m.rental_id
        LEFT JOIN sites p ON r.pickup_site_id = p.site_id LEFT JOIN sites q ON r.return_site_id = q.site_id
        LEFT JOIN vehicles v ON r.vehicle_id = v.vehicle_id
        LEFT JOIN classes c ON v.vehicle_class_id = c.vehicle_class_id""",
    "revenue_by_site": """
        SELECT pickup_site_id, count(DISTINCT rental_id) AS total_rentals,
               CAST(sum(CAST(revenue_usd AS DECIMAL(18,4))) AS DOUBLE) AS total_revenue_usd,
               round(CAST(sum(CAST(revenue_usd AS DECIMAL(18,4))) AS DOUBLE) / count(revenue_usd), 2)
                 AS avg_revenue_per_rental_usd,
               round(avg(rental_days), 1) AS avg_rental_days
        FROM fact GROUP BY pickup_site_id""",
    "revenue_by_month": """
        SELECT pickup_site_id, pickup_site_name, pickup_city, pickup_state,
               CAST(date_trunc('month', pickup_ts) AS DATE) AS revenue_month,
               count(DISTINCT rental_id) AS total_rentals,
               CAST(sum(CAST(revenue_usd AS DECIMAL(18,4))) AS DOUBLE) AS total_revenue_usd
        FROM fact GROUP BY ALL""",
    "idle": """
        SELECT current_site_id, count(DISTINCT vehicle_id) AS vehicles_at_site,
               count(DISTINCT CASE WHEN status = 'idle' THEN vehicle_id END) AS idle_vehicles,
               count(DISTINCT CASE WHEN status = 'rented' THEN vehicle_id END) AS rented_vehicles,
               count(DISTINCT CASE WHEN status = 'maintenance' THEN vehicle_id END) AS maintenance_vehicles
        FROM vehicles GROUP BY current_site_id""",
    "use_month": """
        SELECT m.*, f.fleet_size, CAST(day(last_day(m.rental_month)) AS INTEGER) AS days_in_month
        FROM (SELECT pickup_site_id, CAST(date_trunc('month', pickup_ts) AS DATE) AS rental_month,
                     count(DISTINCT rental_id) AS total_rentals, CAST(sum(rental_days) AS BIGINT) AS total_rented_days
              FROM fact GROUP BY ALL) m
        LEFT JOIN (SELECT current_site_id, count(DISTINCT vehicle_id) AS fleet_size FROM vehicles GROUP BY 1) f
          ON m.pickup_site_id = f.current_site_id""",
    "flows": """
        SELECT pickup_site_id, pickup_site_name, pickup_city, return_site_id, return_site_name, return_city,
               count(DISTINCT rental_id) AS one_way_trips,
               CAST(sum(CAST(revenue_usd AS DECIMAL(18,4))) AS DOUBLE) AS one_way_revenue_usd
        FROM fact WHERE is_one_way GROUP BY ALL""",
    "repair": """
        SELECT m.site_id, s.site_name, s.city AS site_city, s.state AS site_state,
               count(maintenance_id) AS maintenance_events,
               CAST(round(sum(total_cost_usd), 2) AS DOUBLE) AS total_maintenance_cost_usd,
               CAST(round(sum(labor_cost_usd), 2) AS DOUBLE) AS total_labor_cost_usd,
               CAST(round(sum(parts_cost_usd), 2) AS DOUBLE) AS total_parts_cost_usd
        FROM maintenance m LEFT JOIN sites s ON m.site_id = s.site_id GROUP BY ALL""",
    "fresh": """
        SELECT *, round((epoch(TIMESTAMP '2024-01-31') - floor(epoch(latest_snapshot_ts))) / 60.0, 1)
                 AS minutes_since_last_snapshot
        FROM (SELECT vehicle_id, count(event_id) AS snapshots, max(ts) AS latest_snapshot_ts,
                     round(avg(speed_mph), 1) AS avg_speed_mph, max(idle_minutes) AS max_idle_minutes,
                     max(odometer_miles) AS latest_odometer_miles
              FROM tele GROUP BY vehicle_id)""",
}

NEEDS = {
    "paid": ["payments"],
    "fact": ["rentals", "paid", "sites", "vehicles", "classes"],
    "revenue_by_site": ["fact"],
    "revenue_by_month": ["fact"],
    "idle": ["vehicles"],
    "use_month": ["fact", "vehicles"],
    "flows": ["fact"],
    "repair": ["maintenance", "sites"],
    "fresh": ["tele"],
}


def _with(views: str, body: str) -> str:
    ordered: list[str] = []

    def add(name: str) -> None:
        for inner in NEEDS.get(name, []):
            add(inner)
        if name not in ordered:
            ordered.append(name)

    for name in views.split():
        add(name)
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in ordered) + "\n" + body


GEO = "s.site_name, s.city, s.state, s.latitude, s.longitude, s.is_hq, s.parking_capacity"
SITE_OF_FACT = "fact f LEFT JOIN sites s ON f.pickup_site_id = s.site_id"
SPIKE_RANGE = "ts BETWEEN TIMESTAMP '2024-01-10 12:00:00' AND TIMESTAMP '2024-01-12 12:00:00'"
SUM_USD = "CAST(sum(CAST(f.revenue_usd AS DECIMAL(18,4))) AS DOUBLE)"

RENTAL_LINES = f"""
    count(*) AS total_rentals, round({SUM_USD}, 4) AS total_revenue,
    round({SUM_USD} / count(*), 4) AS revenue_per_rental,
    round(avg(f.rental_days), 4) AS average_rental_duration,
    CAST(sum(f.miles_driven) AS BIGINT) AS total_miles_driven,
    count(DISTINCT f.vehicle_id) AS active_vehicles,
    nullif(count(*) FILTER (WHERE f.is_one_way), 0) AS one_way_rentals,
    round(nullif(count(*) FILTER (WHERE f.is_one_way), 0) / CAST(count(*) AS DOUBLE), 4) AS one_way_rental_pct"""

RULES = """
    SELECT 'IdleVehicleAlert' AS rule, 'notify' AS action, vehicle_id AS object_key, event_id, site_id, ts,
           'idle_minutes' AS attribute, CAST(idle_minutes AS VARCHAR) AS value
    FROM tele WHERE idle_minutes > 120
    UNION ALL
    SELECT 'MaintenanceFaultAlert', 'notify', vehicle_id, event_id, site_id, ts, 'fault_code', fault_code
    FROM tele WHERE fault_code <> ''
    UNION ALL
    SELECT 'MaintenanceOverdueAlert', 'notify', vehicle_id, event_id, site_id, ts, 'odometer_miles',
           CAST(odometer_miles AS VARCHAR)
    FROM tele WHERE odometer_miles > 75000
    UNION ALL
    SELECT 'WorkOrderOnFault', 'work_order', vehicle_id, event_id, site_id, ts, 'fault_code', fault_code
    FROM tele WHERE fault_code <> ''"""

IDLE_ALERTS = """
    SELECT vehicle_id, t.site_id, ts, idle_minutes, ignition_state, latitude, longitude
    FROM tele t LEFT JOIN sites s ON t.site_id = s.site_id WHERE idle_minutes > 120"""
FAULT_ALERTS = "SELECT vehicle_id, site_id, ts, fault_code, odometer_miles FROM tele WHERE fault_code <> ''"
OVERDUE_ALERTS = "SELECT vehicle_id, site_id, ts, odometer_miles FROM tele WHERE odometer_miles > 75000"

COUNTED = {
    "sites": "site_id,site_code,site_name,city,state,latitude,longitude,is_hq,parking_capacity,opened_date",
    "vehicle_classes": "vehicle_class_id,class_name,category,daily_base_rate_usd,seats,is_ev",
    "vehicles": "vehicle_id,vin,vehicle_class_id,make,model,model_year,color,license_plate,home_site_id,"
    "current_site_id,status,odometer_miles,acquired_date",
    "customers": "customer_id,first_name,last_name,email,phone,loyalty_tier,home_city,home_state,join_date",
    "reservations": "reservation_id,customer_id,vehicle_class_id,pickup_site_id,return_site_id,reserved_at,pickup_date,"
    "planned_return_date,status",
    "rentals": "rental_id,reservation_id,customer_id,vehicle_id,pickup_site_id,return_site_id,pickup_ts,"
    "planned_return_ts,return_ts,odometer_out,miles_driven,is_one_way,status,rental_days",
    "payments": "payment_id,rental_id,customer_id,base_amount_usd,one_way_fee_usd,taxes_fees_usd,currency,payment_ts,"
    "status,total_amount_usd",
    "maintenance": "maintenance_id,vehicle_id,site_id,labor_cost_usd,parts_cost_usd,opened_ts,status,total_cost_usd",
    "events": "event_id,vehicle_id,site_id,ts,ignition_state,idle_minutes,odometer_miles,fault_code,speed_mph,"
    "fuel_or_soc_pct,is_spike",
    "telematics": "telematics_id,vehicle_id,site_id,snapshot_ts,ignition_state,idle_minutes,odometer_miles,fault_code,"
    "speed_mph,fuel_or_soc_pct,is_spike",
}
SQL_VIEW = {"vehicle_classes": "classes", "events": "tele", "telematics": "tele"}
MANIFEST = " UNION ALL ".join(
    f"SELECT '{n}' AS entity, count(*) AS rows, '{cols}' AS columns FROM {SQL_VIEW.get(n, n)}"
    for n, cols in COUNTED.items()
)

FK = (
    ("vehicles", "vehicle_class_id", "vehicle_classes", "vehicle_class_id"),
    ("vehicles", "home_site_id", "sites", "site_id"),
    ("vehicles", "current_site_id", "sites", "site_id"),
    ("rentals", "vehicle_id", "vehicles", "vehicle_id"),
    ("rentals", "customer_id", "customers", "customer_id"),
    ("rentals", "pickup_site_id", "sites", "site_id"),
    ("rentals", "return_site_id", "sites", "site_id"),
    ("payments", "rental_id", "rentals", "rental_id"),
    ("maintenance", "vehicle_id", "vehicles", "vehicle_id"),
    ("maintenance", "site_id", "sites", "site_id"),
    ("telematics", "vehicle_id", "vehicles", "vehicle_id"),
    ("telematics", "site_id", "sites", "site_id"),
    ("reservations", "customer_id", "customers", "customer_id"),
    ("reservations", "vehicle_class_id", "vehicle_classes", "vehicle_class_id"),
    ("reservations", "pickup_site_id", "sites", "site_id"),
    ("reservations", "return_site_id", "sites", "site_id"),
    ("rentals", "reservation_id", "reservations", "reservation_id"),
)
FK_REPORT = " UNION ALL ".join(
    f"SELECT '{c}' AS child, '{col}' AS \"column\", '{p}' AS parent, count(*) AS orphans FROM {SQL_VIEW.get(c, c)}"
    f" WHERE {col} IS NOT NULL AND {col} NOT IN (SELECT {key} FROM {SQL_VIEW.get(p, p)} WHERE {key} IS NOT NULL)"
    for c, col, p, key in FK
)


def _violations(table: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS rule, count(*) FILTER (WHERE {cond}) AS violations FROM {table}"
        for name, cond in rules.items()
    )


def _required(columns: str) -> dict[str, str]:
    return {f"required:{c}": f"{c} IS NULL" for c in columns.split()}


ALL_VIEWS = "sites classes vehicles customers reservations rentals payments maintenance tele"

# Required columns of each entity; the first is its key.
REQUIRED = {
    "vehicle_classes": "vehicle_class_id class_name category daily_base_rate_usd seats is_ev",
    "sites": "site_id site_code site_name city state latitude longitude is_hq parking_capacity opened_date",
    "vehicles": "vehicle_id vin vehicle_class_id make model model_year color license_plate home_site_id current_site_id status"
    " odometer_miles acquired_date",
    "customers": "customer_id first_name last_name email phone loyalty_tier home_city home_state join_date",
    "reservations": "reservation_id customer_id vehicle_class_id pickup_site_id return_site_id reserved_at pickup_date"
    " planned_return_date status",
    "rentals": "rental_id customer_id vehicle_id vehicle_class_id pickup_site_id return_site_id pickup_ts planned_return_ts"
    " odometer_out is_one_way status",
    "payments": "payment_id rental_id customer_id pickup_site_id rental_days base_amount_usd one_way_fee_usd taxes_fees_usd"
    " total_amount_usd currency payment_method payment_ts status",
    "maintenance": "maintenance_id vehicle_id site_id maintenance_type opened_ts labor_cost_usd parts_cost_usd total_cost_usd"
    " odometer_at_service status",
    "telematics": "telematics_id vehicle_id site_id snapshot_ts ignition_state idle_minutes odometer_miles latitude longitude"
    " speed_mph fuel_or_soc_pct",
}
CODES = {
    "vehicle_classes": {"category": "'Car', 'SUV', 'Luxury', 'Van', 'Truck', 'EV'"},
    "vehicles": {"status": "'available', 'rented', 'idle', 'maintenance'"},
    "customers": {"loyalty_tier": "'None', 'Silver', 'Gold', 'Platinum'"},
    "reservations": {"status": "'booked', 'fulfilled', 'cancelled', 'noshow'"},
    "rentals": {"status": "'open', 'closed'"},
    "payments": {"currency": "'USD'", "status": "'captured', 'refunded', 'failed'"},
    "maintenance": {"status": "'open', 'closed'"},
    "telematics": {"ignition_state": "'on', 'off'"},
}
RENAMED = {"telematics_id": "event_id", "snapshot_ts": "ts"}


def _name(entity: str, column: str) -> str:
    return RENAMED.get(column, column) if entity == "telematics" else column


def _contract(entity: str) -> str:
    held = COUNTED[entity].split(",")
    rules = {
        f"required:{c}" if c in held else f"missing:{c}": f"{_name(entity, c)} IS NULL" if c in held else "true"
        for c in REQUIRED[entity].split()
    }
    rules |= {f"enum:{c}": f"{c} NOT IN ({codes})" for c, codes in CODES.get(entity, {}).items()}
    return f"SELECT '{entity}' AS entity, * FROM ({_violations(SQL_VIEW.get(entity, entity), rules)})"


CONTRACTS = " UNION ALL ".join(map(_contract, REQUIRED))

NUMBERS = (
    "daily_base_rate_usd seats latitude longitude parking_capacity model_year odometer_miles odometer_out miles_driven"
    " base_amount_usd one_way_fee_usd taxes_fees_usd total_amount_usd labor_cost_usd parts_cost_usd total_cost_usd"
    " idle_minutes speed_mph fuel_or_soc_pct"
).split()
DATES = (
    "opened_date acquired_date join_date reserved_at pickup_date planned_return_date pickup_ts planned_return_ts return_ts"
    " payment_ts opened_ts snapshot_ts"
).split()


def _silver(entity: str) -> str:
    """Values left after cleaning: which keys, numbers and dates the faults take away follows from the key's last sign."""
    view, key = SQL_VIEW.get(entity, entity), _name(entity, REQUIRED[entity].split()[0])
    last = f"right(CAST({key} AS VARCHAR), 1)"
    rows = f"(SELECT * FROM {view} WHERE {last} <> '7' QUALIFY row_number() OVER (PARTITION BY {key}) = 1)"
    parts = []
    for c in COUNTED[entity].split(","):
        if c == "rental_days":
            continue
        gone = "3" if c in NUMBERS else "5" if c in DATES else ""
        test = f" FILTER (WHERE {last} <> '{gone}')" if gone and _name(entity, c) != key else ""
        parts.append(f"SELECT '{entity}' AS entity, '{c}' AS \"column\", count(*) AS rows, count({_name(entity, c)}){test} AS \"values\" FROM {rows}")
    return " UNION ALL ".join(parts)


SILVER = " UNION ALL ".join(map(_silver, REQUIRED))


def _pii(table: str, columns: list[str], min_ratio: float) -> str:
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
        "phone": r"\+?[0-9]{1,3}-[0-9]{3}-[0-9]{3}-[0-9]{4}",
    }
    one = """SELECT '{c}' AS "column", '{k}' AS kind, count({c}) AS "values",
               count(*) FILTER (WHERE regexp_matches({c}, '{p}')) AS matches,
               round(count(*) FILTER (WHERE regexp_matches({c}, '{p}')) / CAST(nullif(count({c}), 0) AS DOUBLE), 4) AS ratio,
               coalesce(count(*) FILTER (WHERE regexp_matches({c}, '{p}')) / CAST(nullif(count({c}), 0) AS DOUBLE)
                 >= {m}, false) AS is_pii
             FROM {t}"""
    return " UNION ALL ".join(
        one.format(c=c, k=k, p=p, m=min_ratio, t=table) for c in columns for k, p in kinds.items()
    )


def _smoothed(city: str) -> str:
    key = f"{city}, " if city else ""
    by = city or "true"
    return f"""WITH RECURSIVE s AS (
                 SELECT pickup_site_id AS site, {by} AS k, CAST(year(pickup_ts) * 12 + month(pickup_ts) - 1 AS INTEGER) AS m,
                        CAST(round({SUM_USD}, 2) AS DECIMAL(18,2)) AS y
                 FROM fact f WHERE pickup_ts IS NOT NULL GROUP BY ALL),
               t AS (SELECT k, m, CAST(sum(y) AS DOUBLE) AS y FROM s GROUP BY ALL),
               r AS (SELECT k, min(m) AS lo, max(m) AS hi FROM t GROUP BY k),
               c AS (SELECT k, hi, CAST(unnest(range(lo, hi + 1)) AS INTEGER) AS m FROM r),
               d AS (SELECT c.k, any_value(hi) AS hi, list(coalesce(t.y, 0.0::DOUBLE) ORDER BY c.m) AS y
                     FROM c LEFT JOIN t ON c.k IS NOT DISTINCT FROM t.k AND c.m = t.m GROUP BY c.k),
               p AS (SELECT row_number() OVER () - 1 AS i, a, b, g
                     FROM (VALUES {", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {g}::DOUBLE)" for a in (0.2, 0.5, 0.8) for b in (0.05, 0.2) for g in (0.1, 0.4))}) AS v(a, b, g)),
               h AS (SELECT k, hi, y, i, a, b, g, len(y) AS n,
                            list_reduce(y[1:12], lambda u, w: u + w) / 12.0::DOUBLE AS m1,
                            list_reduce(y[13:24], lambda u, w: u + w) / 12.0::DOUBLE AS m2
                     FROM d, p WHERE len(y) > 24),
               f2 AS (SELECT k, hi, y, i, a, b, g, n, 13 AS pos, m1 AS level, (m2 - m1) / 12.0::DOUBLE AS trend,
                             list_transform(y[1:12], lambda v: v - m1) AS season, 0.0::DOUBLE AS error FROM h
                      UNION ALL
                      SELECT k, hi, y, i, a, b, g, n, pos + 1, moved,
                             b * (moved - level) + (1 - b) * trend,
                             list_append(season[2:12], g * (v - moved) + (1 - g) * before),
                             error + (v - (level + trend + before)) * (v - (level + trend + before))
                      FROM (SELECT *, a * (v - before) + (1 - a) * (level + trend) AS moved
                            FROM (SELECT *, y[pos] AS v, season[1] AS before FROM f2 WHERE pos <= n))),
               w AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY error, i) AS place FROM f2 WHERE pos = n + 1)
               SELECT {"k AS " + key if city else ""}CAST(step AS INTEGER) AS step,
                      CAST(make_date(CAST((hi + step) // 12 AS BIGINT), CAST((hi + step) % 12 + 1 AS BIGINT), 1) AS VARCHAR) AS month,
                      round(level + step * trend + season[step], 2) AS forecast,
                      round(level + step * trend + season[step] - 1.96 * sqrt(error / (n - 12)) * sqrt(step), 2) AS lower,
                      round(level + step * trend + season[step] + 1.96 * sqrt(error / (n - 12)) * sqrt(step), 2) AS upper,
                      a AS alpha, b AS beta, g AS gamma
               FROM w, (SELECT unnest([1, 2, 3]) AS step) WHERE place = 1"""


def _incidents(which: str) -> str:
    return f"""WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 720 MINUTE THEN 0 ELSE 1 END AS begins
                          FROM tele WHERE coalesce(idle_minutes > 90, false) OR coalesce(fault_code <> '', false)
                          WINDOW w AS (PARTITION BY vehicle_id ORDER BY ts, event_id)),
                    n AS (SELECT *, sum(begins) OVER (PARTITION BY vehicle_id ORDER BY ts, event_id) AS number FROM e)
               SELECT vehicle_id, min(ts) AS begin_ts, max(ts) AS end_ts, count(*) AS readings, max(idle_minutes) AS peak_idle_minutes,
                      count(*) FILTER (WHERE fault_code <> '') AS faults
               FROM n GROUP BY vehicle_id, number{which}"""


_ORACLES: dict[str, tuple[str, str]] = {
    # sources
    "dim_site": ("sites", "SELECT * REPLACE (CAST(opened_date AS VARCHAR) AS opened_date) FROM sites"),
    "dim_customer": ("customers", "SELECT * REPLACE (CAST(join_date AS VARCHAR) AS join_date) FROM customers"),
    "json_mapping": (
        "",
        """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
                  json_extract_string(props, '$.k') AS k_text,
                  TRY_CAST(json_extract_string(props, '$.absent') AS BIGINT) AS missing FROM events""",
    ),
    "bronze_ingest": (
        "maintenance",
        """SELECT maintenance_id, vehicle_id, TIMESTAMP '2024-01-31' AS _ingested_at, 'shop' AS _source_system,
                  'raw' AS _source_layer, 'batch-1' AS _batch_id FROM maintenance""",
    ),
    "retention": ("tele", "SELECT event_id, vehicle_id, ts FROM tele WHERE ts >= TIMESTAMP '2024-01-17'"),
    "hot_set": ("tele", "SELECT event_id, ts FROM tele WHERE ts >= TIMESTAMP '2024-01-24'"),
    "manifest": ("sites classes vehicles customers reservations rentals payments maintenance tele", MANIFEST),
    # cleaning, projections, filters
    "dedup_by_key": (
        "",
        """SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
             ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
                      l_returnflag, l_linestatus) = 1""",
    ),
    "null_key_filter": (
        "rentals",
        """SELECT vehicle_id, rental_id, pickup_ts FROM rentals WHERE vehicle_id IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY pickup_ts DESC, rental_id) = 1""",
    ),
    "cast_projection": (
        "",
        """SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS quantity, l_extendedprice AS price,
                  CAST(NULL AS INTEGER) AS flag, l_shipdate AS shipped FROM lineitem""",
    ),
    "text_normalisation": (
        "",
        """SELECT c_custkey, c_name AS name, upper(c_mktsegment) AS segment, lower(c_mktsegment) AS segment_low
           FROM customer""",
    ),
    "one_way_rentals": ("rentals", "SELECT rental_id, pickup_site_id, return_site_id FROM rentals WHERE is_one_way"),
    "odometer_over_limit": ("tele", "SELECT event_id, odometer_miles FROM tele WHERE odometer_miles > 75000"),
    "fault_code_present": ("tele", "SELECT event_id, fault_code FROM tele WHERE fault_code <> ''"),
    "events_in_range": ("", f"SELECT event_id, ts FROM events WHERE {SPIKE_RANGE}"),
    "site_geo": ("sites", "SELECT site_id, latitude, longitude, is_hq, parking_capacity FROM sites"),
    # scalar functions
    "rental_durations": (
        "rentals",
        """SELECT rental_id, rental_days AS days_calendar,
                  CASE WHEN return_ts IS NOT NULL THEN CAST(greatest(1, CAST(epoch(return_ts) - epoch(pickup_ts) AS BIGINT)
                    // 86400) AS INTEGER) END AS days_elapsed,
                  CAST(day(last_day(pickup_ts)) AS INTEGER) AS month_length,
                  strftime(pickup_ts, '%Y-%m-%dT%H:%M:%SZ') AS pickup_iso,
                  'RN' || lpad(CAST(rental_id AS VARCHAR), 8, '0') AS rental_key FROM rentals""",
    ),
    "rental_prices": (
        "rentals vehicles classes",
        """SELECT rental_id, base AS base_amount_usd, fee AS one_way_fee_usd, tax AS taxes_fees_usd,
                  round(base + fee + tax, 2) AS total_amount_usd
           FROM (SELECT *, round((base + fee) * 0.135::DOUBLE, 2) AS tax
                 FROM (SELECT rental_id, CASE WHEN is_one_way THEN 75.0::DOUBLE ELSE 0.0::DOUBLE END AS fee,
                              round(coalesce(daily_base_rate_usd, 50.0) * greatest(1,
                                CAST(epoch(return_ts) - epoch(pickup_ts) AS BIGINT) // 86400), 2) AS base
                       FROM rentals r LEFT JOIN vehicles v ON r.vehicle_id = v.vehicle_id
                       LEFT JOIN classes c ON v.vehicle_class_id = c.vehicle_class_id WHERE r.status = 'closed'))""",
    ),
    # star schema and KPIs
    "dim_vehicle": (
        "vehicles classes",
        """SELECT v.* REPLACE (CAST(acquired_date AS VARCHAR) AS acquired_date), c.class_name, c.category,
                  c.daily_base_rate_usd, c.seats, c.is_ev
           FROM vehicles v LEFT JOIN classes c ON v.vehicle_class_id = c.vehicle_class_id""",
    ),
    "payments_by_rental": ("paid", "SELECT * EXCLUDE (total) FROM paid"),
    "fact_rental": ("fact", "SELECT * FROM fact"),
    "rentals_curated": (
        "rentals sites",
        """SELECT rental_id, vehicle_id, customer_id, pickup_site_id, return_site_id, city AS site_city,
                  state AS site_state, pickup_ts, return_ts, miles_driven, rental_days, is_one_way, status
           FROM rentals LEFT JOIN sites ON pickup_site_id = site_id""",
    ),
    "kpi_revenue_by_site": (
        "revenue_by_site sites",
        """SELECT r.*, s.site_name AS pickup_site_name, s.city AS pickup_city, s.state AS pickup_state
           FROM revenue_by_site r LEFT JOIN sites s ON r.pickup_site_id = s.site_id""",
    ),
    "rented_days_by_class": (
        "fact",
        """SELECT vehicle_class_id, class_name, category, count(DISTINCT rental_id) AS total_rentals,
                  CAST(sum(rental_days) AS BIGINT) AS total_rented_days, round(avg(rental_days), 1) AS avg_rental_days
           FROM fact GROUP BY ALL""",
    ),
    "fleet_size_by_class": (
        "vehicles",
        "SELECT vehicle_class_id, count(DISTINCT vehicle_id) AS fleet_size FROM vehicles GROUP BY 1",
    ),
    "fleet_size_by_site": (
        "vehicles",
        "SELECT home_site_id, count(DISTINCT vehicle_id) AS fleet_size FROM vehicles GROUP BY 1",
    ),
    "kpi_fleet_utilization": (
        "fact vehicles",
        """SELECT a.*, fleet_size, round(total_rentals / CAST(nullif(fleet_size, 0) AS DOUBLE), 2) AS rentals_per_vehicle
           FROM (SELECT vehicle_class_id, class_name, category, count(DISTINCT rental_id) AS total_rentals,
                        CAST(sum(rental_days) AS BIGINT) AS total_rented_days,
                        round(avg(rental_days), 1) AS avg_rental_days FROM fact GROUP BY ALL) a
           LEFT JOIN (SELECT vehicle_class_id, count(DISTINCT vehicle_id) AS fleet_size FROM vehicles GROUP BY 1) b
             ON a.vehicle_class_id = b.vehicle_class_id""",
    ),
    "kpi_one_way_flows": ("flows", "SELECT * FROM flows"),
    "kpi_maintenance_cost": ("repair", "SELECT * FROM repair"),
    "maintenance_cost_by_vehicle": (
        "maintenance",
        """SELECT vehicle_id, count(maintenance_id) AS maintenance_events,
                  CAST(round(sum(total_cost_usd), 2) AS DOUBLE) AS total_maintenance_cost_usd,
                  CAST(round(sum(labor_cost_usd), 2) AS DOUBLE) AS total_labor_cost_usd,
                  CAST(round(sum(parts_cost_usd), 2) AS DOUBLE) AS total_parts_cost_usd
           FROM maintenance GROUP BY vehicle_id""",
    ),
    "payment_revenue_by_site": (
        "payments rentals",
        """SELECT pickup_site_id, count(*) AS payments, CAST(round(sum(total_amount_usd), 2) AS DOUBLE) AS total_revenue_usd
           FROM payments p JOIN rentals r ON p.rental_id = r.rental_id GROUP BY pickup_site_id""",
    ),
    # report-ready aggregates
    "agg_revenue_by_site": (
        "revenue_by_site sites",
        f"SELECT r.*, {GEO} FROM revenue_by_site r LEFT JOIN sites s ON r.pickup_site_id = s.site_id",
    ),
    "agg_revenue_by_site_month": (
        "revenue_by_month",
        "SELECT * REPLACE (CAST(revenue_month AS VARCHAR) AS revenue_month) FROM revenue_by_month",
    ),
    "agg_fleet_utilization_by_site_month": (
        "use_month sites",
        f"""SELECT u.* REPLACE (CAST(rental_month AS VARCHAR) AS rental_month), {GEO},
                   round(total_rented_days / CAST(nullif(fleet_size * days_in_month, 0) AS DOUBLE) * 100.0, 1)
                     AS utilization_pct
            FROM use_month u LEFT JOIN sites s ON u.pickup_site_id = s.site_id""",
    ),
    "fleet_utilization_prorated": (
        "rentals vehicles sites",
        f"""SELECT m.pickup_site_id, CAST(m.rental_month AS VARCHAR) AS rental_month, m.total_rentals, m.total_rented_days,
                   f.fleet_size, {GEO}, CAST(day(last_day(m.rental_month)) AS INTEGER) AS days_in_month,
                   round(m.total_rented_days / CAST(nullif(f.fleet_size * day(last_day(m.rental_month)), 0) AS DOUBLE)
                     * 100.0, 1) AS utilization_pct
            FROM (SELECT pickup_site_id, CAST(date_trunc('month', d) AS DATE) AS rental_month,
                         count(DISTINCT rental_id) AS total_rentals, count(*) AS total_rented_days
                  FROM (SELECT rental_id, pickup_site_id, pickup_ts + to_days(CAST(unnest(range(rental_days)) AS INTEGER)) AS d
                        FROM rentals WHERE rental_days IS NOT NULL) GROUP BY ALL) m
            LEFT JOIN (SELECT home_site_id, count(DISTINCT vehicle_id) AS fleet_size FROM vehicles GROUP BY 1) f
              ON m.pickup_site_id = f.home_site_id
            LEFT JOIN sites s ON m.pickup_site_id = s.site_id""",
    ),
    "agg_idle_vehicles_by_site": (
        "idle sites",
        f"""SELECT i.*, {GEO}, round(idle_vehicles / CAST(vehicles_at_site AS DOUBLE) * 100.0, 1) AS idle_ratio_pct
            FROM idle i LEFT JOIN sites s ON i.current_site_id = s.site_id""",
    ),
    "agg_one_way_flows": (
        "flows sites",
        """SELECT f.*, o.latitude AS pickup_latitude, o.longitude AS pickup_longitude,
                  d.latitude AS return_latitude, d.longitude AS return_longitude
           FROM flows f LEFT JOIN sites o ON f.pickup_site_id = o.site_id
           LEFT JOIN sites d ON f.return_site_id = d.site_id""",
    ),
    "agg_maintenance_cost_by_site": (
        "repair sites",
        """SELECT r.*, s.latitude, s.longitude, s.is_hq, s.parking_capacity
           FROM repair r LEFT JOIN sites s ON r.site_id = s.site_id""",
    ),
    "agg_telematics_freshness": ("fresh", "SELECT * FROM fresh"),
    "spike_summary": (
        "tele",
        f"""SELECT avg(idle_minutes) AS avg_idle, count(*) FILTER (WHERE fault_code <> '') AS faults
            FROM tele WHERE {SPIKE_RANGE}""",
    ),
    "ingest_status": ("", "SELECT count(*) AS rows, max(ts) AS latest_ingestion FROM events"),
    "spike_check": (
        "tele",
        """SELECT count(*) AS events, count(*) FILTER (WHERE is_spike) AS spike_events,
                  count(*) FILTER (WHERE is_spike AND idle_minutes > 120) AS spike_idle,
                  count(*) FILTER (WHERE is_spike AND fault_code <> '') AS spike_faults FROM tele""",
    ),
    # measures and report
    "measures_rental_by_state": (
        "fact sites",
        f"""SELECT a.*, round(total_revenue / n_sites, 4) AS revenue_per_site
            FROM (SELECT s.state, {RENTAL_LINES} FROM {SITE_OF_FACT} GROUP BY s.state) a
            JOIN (SELECT state, count(DISTINCT site_id) AS n_sites FROM sites GROUP BY state) b ON a.state = b.state""",
    ),
    "measures_rental_by_class_sliced": (
        "fact sites",
        f"""SELECT f.class_name, {RENTAL_LINES} FROM {SITE_OF_FACT}
            WHERE s.state IN ('ASIA', 'EUROPE') GROUP BY f.class_name""",
    ),
    "revenue_per_site_by_class": (
        "fact sites customers",
        f"""SELECT f.class_name, c.loyalty_tier,
                   round({SUM_USD} / (SELECT count(DISTINCT site_id) FROM sites WHERE state IN ('ASIA', 'EUROPE')), 4)
                     AS revenue_per_site
            FROM {SITE_OF_FACT} LEFT JOIN customers c ON f.customer_id = c.customer_id
            WHERE s.state IN ('ASIA', 'EUROPE') GROUP BY ALL""",
    ),
    "measures_rental_by_tier": (
        "fact sites customers",
        f"""SELECT c.loyalty_tier, s.state, count(*) AS total_rentals, round({SUM_USD}, 4) AS total_revenue
            FROM {SITE_OF_FACT} LEFT JOIN customers c ON f.customer_id = c.customer_id GROUP BY ALL""",
    ),
    "measures_site_by_state": (
        "revenue_by_site idle repair flows use_month sites",
        """SELECT a.*, b.* EXCLUDE (state), c.* EXCLUDE (state), d.* EXCLUDE (state), e.* EXCLUDE (state)
           FROM (SELECT s.state, round(CAST(sum(CAST(total_revenue_usd AS DECIMAL(18,4))) AS DOUBLE), 4) AS site_revenue,
                        round(avg(avg_revenue_per_rental_usd), 4) AS avg_revenue_per_rental
                 FROM revenue_by_site x LEFT JOIN sites s ON x.pickup_site_id = s.site_id GROUP BY 1) a
           JOIN (SELECT s.state, CAST(sum(idle_vehicles) AS BIGINT) AS idle_vehicle_count,
                        round(sum(idle_vehicles) / CAST(sum(vehicles_at_site) AS DOUBLE), 4) AS idle_vehicle_pct,
                        CAST(sum(vehicles_at_site) AS BIGINT) AS fleet_size,
                        CAST(sum(maintenance_vehicles) AS BIGINT) AS vehicles_in_maintenance
                 FROM idle x LEFT JOIN sites s ON x.current_site_id = s.site_id GROUP BY 1) b ON a.state = b.state
           JOIN (SELECT s.state,
                        round(CAST(sum(CAST(total_maintenance_cost_usd AS DECIMAL(18,4))) AS DOUBLE), 4) AS maintenance_cost,
                        round(CAST(sum(CAST(total_labor_cost_usd AS DECIMAL(18,4))) AS DOUBLE), 4) AS labor_cost,
                        round(CAST(sum(CAST(total_parts_cost_usd AS DECIMAL(18,4))) AS DOUBLE), 4) AS parts_cost,
                        CAST(sum(maintenance_events) AS BIGINT) AS maintenance_events
                 FROM repair x LEFT JOIN sites s ON x.site_id = s.site_id GROUP BY 1) c ON a.state = c.state
           JOIN (SELECT s.state, CAST(sum(one_way_trips) AS BIGINT) AS one_way_trips,
                        round(CAST(sum(CAST(one_way_revenue_usd AS DECIMAL(18,4))) AS DOUBLE), 4) AS one_way_revenue
                 FROM flows x LEFT JOIN sites s ON x.pickup_site_id = s.site_id GROUP BY 1) d ON a.state = d.state
           JOIN (SELECT s.state, CAST(sum(total_rented_days) AS BIGINT) AS rented_vehicle_days,
                        round(sum(total_rented_days) / CAST(sum(fleet_size * days_in_month) AS DOUBLE), 4)
                          AS fleet_utilization_pct
                 FROM use_month x LEFT JOIN sites s ON x.pickup_site_id = s.site_id GROUP BY 1) e ON a.state = e.state""",
    ),
    "measures_monthly_revenue": (
        "revenue_by_month",
        """SELECT CAST(revenue_month AS VARCHAR) AS revenue_month,
                  round(CAST(sum(CAST(total_revenue_usd AS DECIMAL(18,4))) AS DOUBLE), 2) AS monthly_revenue
           FROM revenue_by_month GROUP BY 1""",
    ),
    "measures_telematics": (
        "fresh",
        """SELECT count(DISTINCT vehicle_id) AS telematics_vehicles_tracked,
                  round(avg(minutes_since_last_snapshot), 4) AS avg_telematics_freshness_min,
                  max(max_idle_minutes) AS max_telematics_idle_min FROM fresh""",
    ),
    "measures_one_way_by_return_site": (
        "flows",
        """SELECT return_city AS city, CAST(sum(one_way_trips) AS BIGINT) AS one_way_trips,
                  round(CAST(sum(CAST(one_way_revenue_usd AS DECIMAL(18,4))) AS DOUBLE), 2) AS one_way_revenue
           FROM flows GROUP BY 1""",
    ),
    "measures_secured_by_city": (
        "fact",
        """SELECT pickup_city AS city, count(*) AS total_rentals,
                  round(CAST(sum(CAST(revenue_usd AS DECIMAL(18,4))) AS DOUBLE), 4) AS site_revenue
           FROM fact WHERE pickup_state = 'ASIA' GROUP BY 1""",
    ),
    "kpi_cards": (
        "fact use_month idle repair fresh",
        f"""SELECT (SELECT round({SUM_USD}, 4) FROM fact f) AS total_revenue,
                   (SELECT round(sum(total_rented_days) / CAST(sum(fleet_size * days_in_month) AS DOUBLE), 4)
                    FROM use_month) AS fleet_utilization_pct,
                   (SELECT CAST(sum(idle_vehicles) AS BIGINT) FROM idle) AS idle_vehicle_count,
                   (SELECT round(CAST(sum(CAST(total_maintenance_cost_usd AS DECIMAL(18,4))) AS DOUBLE), 4) FROM repair)
                     AS maintenance_cost,
                   (SELECT count(DISTINCT vehicle_id) FROM fresh) AS telematics_vehicles_tracked""",
    ),
    "kpi_cards_sliced": (
        "fact use_month idle repair fresh sites",
        f"""WITH s AS (SELECT site_id FROM sites WHERE state IN ('ASIA', 'EUROPE'))
            SELECT (SELECT round({SUM_USD}, 4) FROM fact f WHERE pickup_site_id IN (FROM s)) AS total_revenue,
                   (SELECT round(sum(total_rented_days) / CAST(sum(fleet_size * days_in_month) AS DOUBLE), 4)
                    FROM use_month WHERE pickup_site_id IN (FROM s)) AS fleet_utilization_pct,
                   (SELECT CAST(sum(idle_vehicles) AS BIGINT) FROM idle WHERE current_site_id IN (FROM s)) AS idle_vehicle_count,
                   (SELECT round(CAST(sum(CAST(total_maintenance_cost_usd AS DECIMAL(18,4))) AS DOUBLE), 4) FROM repair
                    WHERE site_id IN (FROM s)) AS maintenance_cost,
                   (SELECT count(DISTINCT vehicle_id) FROM fresh) AS telematics_vehicles_tracked""",
    ),
    "revenue_decomposition_sliced": (
        "fact",
        f"""SELECT pickup_state AS state, pickup_city AS city, class_name,
                   CAST(3 - grouping(pickup_state) - grouping(pickup_city) - grouping(class_name) AS INTEGER) AS depth,
                   round({SUM_USD}, 2) AS total_revenue
            FROM fact f WHERE pickup_state IN ('ASIA', 'EUROPE') GROUP BY ROLLUP (pickup_state, pickup_city, class_name)""",
    ),
    "revenue_per_rental_by_geography": (
        "fact",
        f"""SELECT pickup_state AS state, pickup_city AS city, pickup_site_name AS site_name,
                   CAST(3 - grouping(pickup_state) - grouping(pickup_city) - grouping(pickup_site_name) AS INTEGER) AS depth,
                   round({SUM_USD} / count(*), 4) AS revenue_per_rental
            FROM fact f GROUP BY ROLLUP (pickup_state, pickup_city, pickup_site_name)""",
    ),
    "sites_by_revenue_in_order": (
        "revenue_by_site",
        """SELECT pickup_site_id, total_revenue_usd, row_number() OVER (ORDER BY total_revenue_usd DESC, pickup_site_id) AS position
           FROM revenue_by_site""",
    ),
    "revenue_by_month_in_order": (
        "revenue_by_month",
        """SELECT pickup_site_id, CAST(revenue_month AS VARCHAR) AS revenue_month, total_rentals,
                  row_number() OVER (ORDER BY pickup_site_id, revenue_month) AS position
           FROM revenue_by_month""",
    ),
    "formatted_measures": (
        "fact",
        f"""SELECT pickup_state AS state, format('{{:,}}', count(*)) AS total_rentals,
                   '$' || format('{{:,.0f}}', {SUM_USD}) AS total_revenue,
                   '$' || format('{{:,.2f}}', {SUM_USD} / count(*)) AS revenue_per_rental,
                   format('{{:,.1f}}', count(*) FILTER (WHERE is_one_way) / CAST(count(*) AS DOUBLE) * 100) || '%' AS one_way_rental_pct
            FROM fact f GROUP BY 1""",
    ),
    "idle_vehicles_in_order": (
        "vehicles sites",
        """SELECT *, row_number() OVER (ORDER BY idle_vehicles DESC, site_name) AS position
           FROM (SELECT s.site_name, count(*) AS idle_vehicles FROM vehicles v JOIN sites s ON v.current_site_id = s.site_id
                 WHERE v.status = 'idle' GROUP BY 1)""",
    ),
    "revenue_by_city": (
        "fact",
        f"SELECT pickup_city AS city, round({SUM_USD}, 2) AS site_revenue FROM fact f GROUP BY 1",
    ),
    "site_map": (
        "fact sites",
        f"""SELECT r.city, latitude, longitude, site_revenue
            FROM (SELECT s.city, round({SUM_USD}, 2) AS site_revenue FROM {SITE_OF_FACT} GROUP BY s.city) r
            JOIN (SELECT city, avg(latitude) AS latitude, avg(longitude) AS longitude FROM sites GROUP BY city) m
              ON r.city = m.city""",
    ),
    "revenue_decomposition": (
        "fact",
        f"""SELECT pickup_state AS state, pickup_city AS city, class_name,
                   CAST(3 - grouping(pickup_state) - grouping(pickup_city) - grouping(class_name) AS INTEGER) AS depth,
                   round({SUM_USD}, 2) AS total_revenue
            FROM fact f GROUP BY ROLLUP (pickup_state, pickup_city, class_name)""",
    ),
    "rentals_by_geography": (
        "fact",
        """SELECT pickup_state AS state, pickup_city AS city, pickup_site_name AS site_name,
                  CAST(3 - grouping(pickup_state) - grouping(pickup_city) - grouping(pickup_site_name) AS INTEGER) AS depth,
                  count(*) AS total_rentals
           FROM fact GROUP BY ROLLUP (pickup_state, pickup_city, pickup_site_name)""",
    ),
    "rentals_by_fleet_hierarchy": (
        "fact",
        """SELECT category, class_name, vehicle_id,
                  CAST(3 - grouping(category) - grouping(class_name) - grouping(vehicle_id) AS INTEGER) AS depth,
                  count(*) AS total_rentals
           FROM fact GROUP BY ROLLUP (category, class_name, vehicle_id)""",
    ),
    "vehicles_by_geography": (
        "fact",
        """SELECT pickup_state AS state, pickup_city AS city, pickup_site_name AS site_name,
                  CAST(3 - grouping(pickup_state) - grouping(pickup_city) - grouping(pickup_site_name) AS INTEGER) AS depth,
                  count(DISTINCT vehicle_id) AS active_vehicles
           FROM fact GROUP BY ROLLUP (pickup_state, pickup_city, pickup_site_name)""",
    ),
    "maintained_revenue_by_site_month": (
        "revenue_by_month",
        "SELECT * REPLACE (CAST(revenue_month AS VARCHAR) AS revenue_month) FROM revenue_by_month",
    ),
    "maintained_one_way_flows": (
        "flows sites",
        """SELECT f.*, o.latitude AS pickup_latitude, o.longitude AS pickup_longitude,
                  d.latitude AS return_latitude, d.longitude AS return_longitude
           FROM flows f LEFT JOIN sites o ON f.pickup_site_id = o.site_id
           LEFT JOIN sites d ON f.return_site_id = d.site_id""",
    ),
    "committed_events": (
        "tele",
        """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date, count(*) AS events, CAST(sum(idle_minutes) AS BIGINT) AS idle_sum
           FROM tele WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1""",
    ),
    "revenue_forecast_smoothed": ("fact", _smoothed("pickup_city")),
    "revenue_forecast_smoothed_total": ("fact", _smoothed("")),
    "revenue_forecast": (
        "fact",
        """SELECT pickup_city, CAST(step AS INTEGER) AS step,
                  CAST(CAST(last + to_months(CAST(step AS INTEGER)) AS DATE) AS VARCHAR) AS month,
                  round(b + a * (te + step), 2) AS forecast,
                  round(b + a * (te + step) - 1.96 * sigma, 2) AS lower,
                  round(b + a * (te + step) + 1.96 * sigma, 2) AS upper
           FROM (SELECT pickup_city, count(*) AS n, max(revenue_month) AS last, max(t) AS te,
                        regr_slope(y, t) AS a, regr_intercept(y, t) AS b,
                        sqrt(greatest(0.0, regr_syy(y, t) * (1 - regr_r2(y, t)))
                          / CASE WHEN count(*) > 2 THEN count(*) - 2 END) AS sigma
                 FROM (SELECT pickup_city, CAST(date_trunc('month', pickup_ts) AS DATE) AS revenue_month,
                              CAST(sum(CAST(revenue_usd AS DECIMAL(18,4))) AS DOUBLE) AS y,
                              CAST(year(revenue_month) * 12 + month(revenue_month) - 24000 AS DOUBLE) AS t
                       FROM fact GROUP BY ALL) GROUP BY pickup_city),
                range(1, 4) AS r(step)""",
    ),
    "revenue_forecast_total": (
        "fact",
        """SELECT CAST(step AS INTEGER) AS step, CAST(CAST(last + to_months(CAST(step AS INTEGER)) AS DATE) AS VARCHAR) AS month,
                  round(b + a * (te + step), 2) AS forecast, round(b + a * (te + step) - 1.96 * sigma, 2) AS lower,
                  round(b + a * (te + step) + 1.96 * sigma, 2) AS upper
           FROM (SELECT max(m) AS last, max(t) AS te, regr_slope(y, t) AS a, regr_intercept(y, t) AS b,
                        sqrt(greatest(0.0, regr_syy(y, t) * (1 - regr_r2(y, t)))
                          / CASE WHEN count(*) > 2 THEN count(*) - 2 END) AS sigma
                 FROM (SELECT CAST(date_trunc('month', pickup_ts) AS DATE) AS m,
                              CAST(sum(CAST(revenue_usd AS DECIMAL(18,4))) AS DOUBLE) AS y,
                              CAST(year(m) * 12 + month(m) - 24000 AS DOUBLE) AS t FROM fact GROUP BY ALL)),
                range(1, 4) AS r(step)""",
    ),
    # windows and ranking
    "latest_snapshot": (
        "tele",
        """SELECT vehicle_id, event_id AS telematics_id, ts AS snapshot_ts, odometer_miles, idle_minutes FROM tele
           WHERE vehicle_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY ts DESC, event_id) = 1""",
    ),
    "new_since": ("", "SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-20'"),
    "reading_change": (
        "tele",
        """SELECT event_id, vehicle_id, ts, odometer_miles, lag(odometer_miles) OVER w AS previous_odometer_miles,
                  odometer_miles - lag(odometer_miles) OVER w AS odometer_miles_change
           FROM tele WINDOW w AS (PARTITION BY vehicle_id ORDER BY ts, event_id)""",
    ),
    "top_one_way_flows": (
        "flows",
        """SELECT pickup_site_id, return_site_id, one_way_trips FROM flows
           ORDER BY one_way_trips DESC, pickup_site_id, return_site_id LIMIT 10""",
    ),
    "idle_site_ranking": (
        "idle sites",
        """SELECT site_name, idle_vehicles, rank() OVER (ORDER BY idle_vehicles DESC) AS rank
           FROM idle LEFT JOIN sites ON current_site_id = site_id QUALIFY rank <= 5""",
    ),
    "top_sites_per_state": (
        "revenue_by_site sites",
        """SELECT s.state AS pickup_state, s.city AS pickup_city, total_revenue_usd,
                  row_number() OVER (PARTITION BY s.state ORDER BY total_revenue_usd DESC, r.pickup_site_id) AS rank
           FROM revenue_by_site r LEFT JOIN sites s ON r.pickup_site_id = s.site_id QUALIFY rank <= 2""",
    ),
    # graph
    "graph_idle_vehicles_by_site": (
        "vehicles sites",
        """SELECT site_name, count(*) AS idle_vehicles FROM vehicles JOIN sites ON current_site_id = site_id
           WHERE status = 'idle' GROUP BY 1""",
    ),
    "graph_one_way_paths": (
        "rentals sites",
        """SELECT p.site_name AS pickup_site, q.site_name AS return_site, count(*) AS trips
           FROM rentals JOIN sites p ON pickup_site_id = p.site_id JOIN sites q ON return_site_id = q.site_id
           WHERE p.site_id <> q.site_id GROUP BY ALL""",
    ),
    "graph_vehicles_at": (
        "vehicles sites",
        """SELECT vin, make, model, status FROM vehicles JOIN sites ON current_site_id = site_id
           WHERE site_name = 'NATION_7'""",
    ),
    # data quality
    "customers_without_rental": (
        "customers",
        """SELECT customer_id, email, home_city FROM customers
           WHERE customer_id NOT IN (SELECT o_custkey FROM orders)""",
    ),
    "fk_resolution": (
        "rentals vehicles",
        """SELECT count(*) AS child_rows, count(v.vehicle_id) AS resolved_rows,
                  count(*) FILTER (WHERE r.vehicle_id IS NOT NULL AND v.vehicle_id IS NULL) AS orphan_rows,
                  count(*) FILTER (WHERE r.vehicle_id IS NULL) AS null_keys
           FROM rentals r LEFT JOIN vehicles v ON r.vehicle_id = v.vehicle_id""",
    ),
    "fk_report": ("sites classes vehicles customers reservations rentals payments maintenance tele", FK_REPORT),
    "key_uniqueness": (
        "",
        """SELECT CAST(sum(n) AS BIGINT) AS rows, 0::BIGINT AS null_keys, count(*) FILTER (WHERE n > 1) AS repeated_keys,
                  CAST(sum(n - 1) AS BIGINT) AS surplus_rows
           FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
    ),
    "contract_rentals": (
        "rentals",
        _violations(
            "rentals",
            {
                **_required(
                    "rental_id customer_id vehicle_id pickup_site_id return_site_id pickup_ts planned_return_ts"
                    " odometer_out is_one_way status"
                ),
                "missing:vehicle_class_id": "true",
                "enum:status": "status NOT IN ('open', 'closed')",
                "closed_without_return": "status = 'closed' AND return_ts IS NULL",
            },
        ),
    ),
    "contract_vehicles": (
        "vehicles",
        _violations(
            "vehicles",
            {
                **_required(
                    "vehicle_id vin vehicle_class_id make model model_year color license_plate home_site_id"
                    " current_site_id status odometer_miles acquired_date"
                ),
                "enum:status": "status NOT IN ('available', 'rented', 'idle', 'maintenance')",
                "moved": "home_site_id <> current_site_id",
            },
        ),
    ),
    "contract_events": (
        "tele",
        _violations(
            "tele",
            {
                **_required(
                    "event_id vehicle_id site_id ts ignition_state odometer_miles speed_mph fuel_or_soc_pct is_spike"
                ),
                "required:idle_minutes": "fault_code IS NULL",
                "missing:latitude": "true",
                "missing:longitude": "true",
                "enum:ignition_state": "ignition_state NOT IN ('on', 'off')",
                "type:idle_minutes": "fault_code IS NOT NULL AND TRY_CAST(fault_code AS INTEGER) IS NULL",
            },
        ),
    ),
    "contracts_of_all_entities": (ALL_VIEWS, CONTRACTS),
    "bronze_ingest_all": (
        ALL_VIEWS,
        " UNION ALL ".join(
            f"SELECT '{n}' AS entity, count(*) AS rows, count(*) AS stamped, 'shop' AS source FROM {SQL_VIEW.get(n, n)}" for n in REQUIRED
        ),
    ),
    "silver_of_all_entities": (ALL_VIEWS, SILVER),
    "layer_reconciliation": (
        "rentals payments paid",
        """WITH a AS (SELECT pickup_site_id, CAST(sum(total_amount_usd) AS DOUBLE) AS revenue,
                             CAST(count(DISTINCT p.rental_id) FILTER (WHERE total_amount_usd > 0) AS DOUBLE) AS rentals
                      FROM payments p JOIN rentals r ON p.rental_id = r.rental_id GROUP BY 1),
                b AS (SELECT pickup_site_id, CAST(sum(CAST(coalesce(m.revenue_usd, 0) AS DECIMAL(18,4))) AS DOUBLE) AS revenue,
                             CAST(count(*) FILTER (WHERE m.revenue_usd > 0) AS DOUBLE) AS rentals
                      FROM rentals r LEFT JOIN paid m ON r.rental_id = m.rental_id GROUP BY 1),
                pair AS (SELECT coalesce(a.pickup_site_id, b.pickup_site_id) AS pickup_site_id, a.revenue AS r1,
                                b.revenue AS r2, a.rentals AS n1, b.rentals AS n2
                         FROM a FULL JOIN b ON a.pickup_site_id = b.pickup_site_id)
           SELECT pickup_site_id, measure, round(l, 2) AS left_total, round(r, 2) AS right_total,
                  round(l - r, 2) + 0.0 AS difference, coalesce(abs(l - r) <= 0.02, false) AS matches
           FROM (SELECT pickup_site_id, 'revenue' AS measure, r1 AS l, r2 AS r FROM pair
                 UNION ALL SELECT pickup_site_id, 'rentals', n1, n2 FROM pair)""",
    ),
    "differing_rows": (
        "rentals",
        """SELECT rental_id, customer_id, miles_driven, 'left' AS side FROM rentals WHERE rental_id % 1000 = 7 OR rental_id = 11
           UNION ALL
           SELECT rental_id, customer_id, CASE WHEN rental_id % 1000 = 7 THEN coalesce(miles_driven, 0) + 1 ELSE miles_driven END, 'right'
           FROM rentals WHERE rental_id % 1000 = 7 OR rental_id = 12""",
    ),
    "one_answer_two_ways": (
        "idle",
        """SELECT count(*) AS left_rows, count(*) AS right_rows, 0::BIGINT AS differing_rows
           FROM idle WHERE idle_vehicles > 0""",
    ),
    "one_way_flag_check": (
        "rentals",
        """SELECT count(*) AS left_rows, count(*) AS right_rows,
                  2 * count(*) FILTER (WHERE is_one_way <> (pickup_site_id <> return_site_id)) AS differing_rows
           FROM rentals""",
    ),
    "pii_columns": ("", _pii("documents", ["text", "lang", "source"], 0.05)),
    "pii_customers": (
        "customers",
        _pii(
            "customers", ["first_name", "last_name", "email", "phone", "loyalty_tier", "home_city", "home_state"], 0.5
        ),
    ),
    # policies
    "row_filter_manager": (
        "rentals sites",
        """SELECT rental_id, city AS site_city, status FROM rentals JOIN sites ON pickup_site_id = site_id
           WHERE city = 'ASIA-2'""",
    ),
    "row_filter_admin": (
        "rentals sites",
        "SELECT rental_id, city AS site_city FROM rentals LEFT JOIN sites ON pickup_site_id = site_id",
    ),
    "row_filter_outsider": (
        "rentals sites",
        """SELECT 'all_sites' AS principal, count(*) AS visible_rentals FROM rentals
           UNION ALL SELECT 'managers_asia', count(*) FILTER (WHERE city = 'ASIA-2')
             FROM rentals LEFT JOIN sites ON pickup_site_id = site_id
           UNION ALL SELECT 'managers_europe', count(*) FILTER (WHERE city = 'EUROPE-1')
             FROM rentals LEFT JOIN sites ON pickup_site_id = site_id
           UNION ALL SELECT 'guests', 0""",
    ),
    "masked_customers": (
        "customers",
        "SELECT customer_id, '***@masked.invalid' AS email, loyalty_tier FROM customers",
    ),
    "hidden_columns": (
        "customers",
        """SELECT * EXCLUDE (email, phone) REPLACE (CAST(join_date AS VARCHAR) AS join_date) FROM customers""",
    ),
    "rls_by_mapping": (
        "rentals sites",
        """SELECT rental_id, pickup_site_id, is_one_way FROM rentals
           WHERE pickup_site_id IN (SELECT site_id FROM sites WHERE state = 'EUROPE')""",
    ),
    "policy_set": (
        "customers",
        """SELECT * EXCLUDE (phone) REPLACE (CAST(join_date AS VARCHAR) AS join_date, '***' AS email) FROM customers
           WHERE home_city = 'ASIA-2'""",
    ),
    "sql_functions": (
        "customers",
        "SELECT customer_id, '***@masked.invalid' AS email, home_city FROM customers WHERE home_city = 'ASIA-0'",
    ),
    "policy_set_denied": (
        "rentals",
        "SELECT 'applied' AS rule, '***@masked.invalid' AS status, count(*) AS visible_rentals FROM rentals",
    ),
    # alerts on a table
    "idle_alerts": ("tele sites", IDLE_ALERTS),
    "fault_alerts": ("tele", FAULT_ALERTS),
    "overdue_alerts": ("tele", OVERDUE_ALERTS),
    "rule_alerts": ("tele", RULES),
    "spike_windows": (
        "tele",
        """SELECT w AS window_start, w + INTERVAL 10 MINUTE AS window_end, count(*) AS events, avg(idle_minutes) AS avg_idle,
                  count(*) FILTER (WHERE fault_code <> '') AS faults
           FROM (SELECT *, time_bucket(INTERVAL 10 MINUTE, ts) AS w FROM tele) GROUP BY w HAVING avg(idle_minutes) >= 45""",
    ),
    # streams
    "stream_telematics_curated": (
        "tele sites",
        """SELECT event_id AS telematics_id, vehicle_id, ts AS snapshot_ts, latitude, longitude, speed_mph,
                  odometer_miles, idle_minutes, fuel_or_soc_pct
           FROM tele t LEFT JOIN sites s ON t.site_id = s.site_id""",
    ),
    "stream_idle_alerts": ("tele sites", IDLE_ALERTS),
    "stream_fault_alerts": ("tele", FAULT_ALERTS),
    "stream_overdue_alerts": ("tele", OVERDUE_ALERTS),
    "stream_rule_alerts": ("tele", RULES),
    "stream_work_orders": (
        "tele",
        """SELECT 'WorkOrderOnFault:' || event_id AS work_order_id, site_id, vehicle_id, fault_code AS reason,
                  ts AS opened_ts FROM tele WHERE fault_code <> ''""",
    ),
    "stream_spike_windows": (
        "tele",
        """SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, count(*) AS events, avg(idle_minutes) AS avg_idle,
                  count(*) FILTER (WHERE fault_code <> '') AS faults
           FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS w FROM tele) GROUP BY w""",
    ),
    "stream_dedup_events": ("tele", "SELECT event_id, vehicle_id, ts, odometer_miles FROM tele"),
    "stream_landed_events": (
        "tele",
        """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date, count(*) AS events, count(*) AS stamped,
                  CAST(sum(odometer_miles) AS BIGINT) AS odometer_sum FROM tele GROUP BY 1""",
    ),
    "incidents": ("tele", _incidents("")),
    "stream_incidents": (
        "tele",
        _incidents(
            """ HAVING max(ts) + INTERVAL 720 MINUTE
                       <= (SELECT date_trunc('milliseconds', max(ts)) FROM tele) - INTERVAL 10 MINUTE"""
        ),
    ),
    "stream_presence": (
        "tele",
        """WITH r AS (SELECT vehicle_id, event_id, ts, odometer_miles AS miles,
                          lag(odometer_miles) OVER w AS previous, lead(ts) OVER w AS next,
                          (SELECT date_trunc('milliseconds', max(ts)) FROM tele WHERE vehicle_id IS NOT NULL) - INTERVAL 10 MINUTE AS mark
                   FROM tele WHERE vehicle_id IS NOT NULL
                   WINDOW w AS (PARTITION BY vehicle_id ORDER BY ts, CAST(event_id AS VARCHAR)))
           SELECT vehicle_id, 'reading' AS what, CAST(event_id AS VARCHAR) AS event_id, ts AS at, miles, previous AS previous_miles,
                  miles - previous AS miles_change FROM r WHERE ts <= mark
           UNION ALL
           SELECT vehicle_id, 'silent', NULL, ts + INTERVAL 240 MINUTE, miles, NULL, NULL FROM r
           WHERE ts <= mark AND least(coalesce(next, mark), mark) - ts > INTERVAL 240 MINUTE""",
    ),
    "stream_enriched_events": (
        "tele vehicles sites",
        """SELECT t.event_id, t.vehicle_id, v.current_site_id AS fleet_site_id, coalesce(s.latitude, 47.6062) AS site_latitude,
                  coalesce(s.longitude, -122.3321) AS site_longitude, v.vehicle_id IS NOT NULL AS vehicle_known
           FROM tele t LEFT JOIN vehicles v ON t.vehicle_id = v.vehicle_id
           LEFT JOIN sites s ON v.current_site_id = s.site_id""",
    ),
}


def all_oracles() -> dict[str, str]:
    out = {}
    for name, (views, body) in _ORACLES.items():
        sql = _with(views, body)
        # An oracle with its own WITH continues the list of views.
        if body.lstrip().startswith("WITH RECURSIVE "):
            sql = sql.replace("\nWITH RECURSIVE ", "\nWITH ", 1).replace("WITH ", "WITH RECURSIVE ", 1)
        out[name] = sql.replace("\nWITH ", ",\n", 1) if views and body.lstrip().startswith("WITH ") else sql
    return out
