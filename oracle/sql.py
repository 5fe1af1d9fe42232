"""Oracle SQL (DuckDB) for every registered query that SQL can express."""

from __future__ import annotations

from oracle.ctes import sk, ts, with_ctes

ORACLE: dict[str, str] = {}


def rounded(sql: str, cols: list[str]) -> str:
    rep = ", ".join(f"round(CAST({c} AS DOUBLE), 4) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) q"


# -- semantic views ---------------------------------------------------------------------
FTS_J = """fact_ticket_sales f
  LEFT JOIN dim_date d ON f.purchase_date_key = d.date_key
  LEFT JOIN dim_customer c ON f.customer_key = c.customer_key
  LEFT JOIN dim_location l ON f.location_key = l.location_key
  LEFT JOIN dim_ticket_type tt ON f.ticket_type_key = tt.ticket_type_key"""
FR_J = """fact_rentals f
  LEFT JOIN dim_date d ON f.rental_date_key = d.date_key
  LEFT JOIN dim_customer c ON f.customer_key = c.customer_key
  LEFT JOIN dim_location l ON f.location_key = l.location_key
  LEFT JOIN dim_product p ON f.product_key = p.product_key"""
FFB_J = """fact_food_beverage f
  LEFT JOIN dim_date d ON f.transaction_date_key = d.date_key
  LEFT JOIN dim_customer c ON f.customer_key = c.customer_key
  LEFT JOIN dim_location l ON f.location_key = l.location_key
  LEFT JOIN dim_product p ON f.product_key = p.product_key"""
REV_CTES = ["fact_ticket_sales", "fact_rentals", "fact_food_beverage", "dim_date", "dim_customer", "dim_location",
            "dim_product", "dim_ticket_type"]

TICKET_METRICS = {
    "TICKET_REVENUE": "sum(f.purchase_amount)",
    "TICKETS_SOLD": "count(f.sale_key)",
    "ADVANCE_SALES_SHARE_PCT": "count(CASE WHEN f.is_advance_purchase THEN 1 END) / NULLIF(count(f.sale_key), 0) * 100",
    "ONLINE_CHANNEL_REVENUE": "sum(CASE WHEN f.purchase_channel = 'online' THEN f.purchase_amount END)",
    "ONLINE_CHANNEL_SHARE_PCT": "CAST(sum(CASE WHEN f.purchase_channel = 'online' THEN f.purchase_amount END) AS DOUBLE)"
                                " / NULLIF(CAST(sum(f.purchase_amount) AS DOUBLE), 0) * 100",
    "AVERAGE_TICKET_PRICE": "CAST(sum(f.purchase_amount) AS DOUBLE) / NULLIF(count(f.sale_key), 0)",
}
RENTAL_METRICS = {
    "RENTAL_REVENUE": "sum(f.rental_amount)",
    "RENTAL_TRANSACTIONS": "count(f.rental_key)",
    "RENTAL_MARKUP_DOLLARS": "sum(f.rental_markup)",
}
FNB_METRICS = {
    "FNB_REVENUE": "sum(f.total_amount)",
    "FNB_TRANSACTIONS": "count(f.transaction_key)",
    "FNB_UPSELL_REVENUE": "sum(f.upsell_amount)",
}
DOUBLE_REV = {"TICKET_REVENUE", "ADVANCE_SALES_SHARE_PCT", "ONLINE_CHANNEL_REVENUE", "ONLINE_CHANNEL_SHARE_PCT",
              "AVERAGE_TICKET_PRICE", "RENTAL_REVENUE", "RENTAL_MARKUP_DOLLARS", "FNB_REVENUE", "FNB_UPSELL_REVENUE",
              "TOTAL_REVENUE"}


def drill_across(parts: list[tuple[str, dict[str, str]]], dims: dict[str, str], metrics: list[str],
                 derived: dict[str, str] | None = None) -> str:
    """Union-all of per-fact aggregates, re-aggregated on the dimensions (one row each)."""
    all_metrics = [m for _, ms in parts for m in ms]
    selects = []
    for from_sql, ms in parts:
        dsel = [f"{expr} AS {name}" for name, expr in dims.items()]
        msel = [f"{ms[m]} AS {m}" if m in ms else f"NULL AS {m}" for m in all_metrics]
        group = f" GROUP BY {', '.join(str(i + 1) for i in range(len(dims)))}" if dims else ""
        selects.append(f"SELECT {', '.join(dsel + msel)} FROM {from_sql}{group}")
    inner = "\nUNION ALL\n".join(selects)
    # count metrics: max() keeps BIGINT; every (dims) row appears once per fact
    outer_m = [f"max({m}) AS {m}" for m in all_metrics]
    group = f" GROUP BY {', '.join(dims)}" if dims else ""
    body = f"SELECT {', '.join(list(dims) + outer_m)} FROM (\n{inner}\n) u{group}"
    out_cols = list(dims) + metrics
    extra = ""
    if derived:
        extra = ", " + ", ".join(f"{e} AS {n}" for n, e in derived.items())
    return f"SELECT {', '.join(out_cols)} FROM (SELECT *{extra} FROM ({body}) b) z"


TOTAL_REV = {"TOTAL_REVENUE": "coalesce(TICKET_REVENUE, 0) + coalesce(RENTAL_REVENUE, 0) + coalesce(FNB_REVENUE, 0)"}


def _revenue(dims_expr: dict[str, str], metrics: list[str]) -> str:
    parts = []
    for j, ms in ((FTS_J, TICKET_METRICS), (FR_J, RENTAL_METRICS), (FFB_J, FNB_METRICS)):
        use = {m: ms[m] for m in metrics if m in ms}
        if use or ("TOTAL_REVENUE" in metrics and any(k.endswith("_REVENUE") for k in ms)):
            if "TOTAL_REVENUE" in metrics:
                for k in ms:
                    if k in ("TICKET_REVENUE", "RENTAL_REVENUE", "FNB_REVENUE"):
                        use[k] = ms[k]
            parts.append((j, use))
    derived = TOTAL_REV if "TOTAL_REVENUE" in metrics else None
    body = drill_across(parts, dims_expr, metrics, derived)
    return with_ctes(REV_CTES, rounded(body, [m for m in metrics if m in DOUBLE_REV]))


ALL_REV = list(TICKET_METRICS) + list(RENTAL_METRICS) + list(FNB_METRICS)
ORACLE["sem_revenue_by_season_segment"] = _revenue(
    {"SKI_SEASON": "d.ski_season", "CUSTOMER_SEGMENT": "c.customer_segment"},
    ["TICKET_REVENUE", "RENTAL_REVENUE", "FNB_REVENUE", "TOTAL_REVENUE"])
ORACLE["sem_revenue_by_location_type"] = _revenue({"LOCATION_TYPE": "l.location_type"}, ALL_REV)
ORACLE["sem_revenue_by_ticket_category"] = _revenue(
    {"TICKET_CATEGORY": "tt.ticket_category", "MONTH_NAME": "d.month_name"}, list(TICKET_METRICS))
ORACLE["sem_revenue_by_product_category"] = _revenue(
    {"PRODUCT_CATEGORY": "p.product_category"}, list(RENTAL_METRICS) + list(FNB_METRICS))
ORACLE["sem_revenue_totals"] = _revenue({}, ["TICKET_REVENUE", "RENTAL_REVENUE", "FNB_REVENUE", "TOTAL_REVENUE"])

PU_J = """fact_pass_usage f
  LEFT JOIN dim_date d ON f.date_key = d.date_key
  LEFT JOIN dim_customer c ON f.customer_key = c.customer_key"""

BEHAVIOR = {
    "TOTAL_VISITS": "count(f.usage_key)",
    "UNIQUE_CUSTOMERS": "count(DISTINCT f.customer_key)",
    "PASS_HOLDER_VISITS": "count(CASE WHEN c.is_pass_holder THEN 1 END)",
    "WEEKEND_VISITS": "count(CASE WHEN d.is_weekend THEN 1 END)",
    "PASS_HOURS_TOTAL": "sum(f.hours_on_mountain)",
    "TOTAL_LIFT_RIDES_SUM": "CAST(sum(f.total_lift_rides) AS BIGINT)",
    "VISITS_PER_CUSTOMER": "count(f.usage_key) / NULLIF(count(DISTINCT f.customer_key), 0)",
    "PASS_RETENTION_PCT": "count(DISTINCT CASE WHEN c.is_pass_holder THEN f.customer_key END)"
                          " / NULLIF(count(DISTINCT f.customer_key), 0) * 100",
    "WEEKEND_SHARE_PCT": "count(CASE WHEN d.is_weekend THEN 1 END) / NULLIF(count(f.usage_key), 0) * 100",
    "AVERAGE_HOURS_PER_VISIT": "sum(f.hours_on_mountain) / NULLIF(count(f.usage_key), 0)",
    "AVERAGE_LIFT_RIDES_PER_VISIT": "sum(f.total_lift_rides) / NULLIF(count(f.usage_key), 0)",
}
B_DOUBLE = ["PASS_HOURS_TOTAL", "VISITS_PER_CUSTOMER", "PASS_RETENTION_PCT", "WEEKEND_SHARE_PCT",
            "AVERAGE_HOURS_PER_VISIT", "AVERAGE_LIFT_RIDES_PER_VISIT"]


def single(from_sql: str, dims: dict[str, str], metrics: dict[str, str], doubles: list[str], ctes: list[str]) -> str:
    sel = [f"{e} AS {n}" for n, e in dims.items()] + [f"{e} AS {n}" for n, e in metrics.items()]
    group = f" GROUP BY {', '.join(str(i + 1) for i in range(len(dims)))}" if dims else ""
    return with_ctes(ctes, rounded(f"SELECT {', '.join(sel)} FROM {from_sql}{group}", doubles))


ORACLE["sem_customer_behavior_by_segment_age"] = single(
    PU_J, {"CUSTOMER_SEGMENT": "c.customer_segment", "AGE_GROUP": "c.age_group"}, BEHAVIOR, B_DOUBLE,
    ["fact_pass_usage", "dim_date", "dim_customer"])

DAILY = {
    "TOTAL_VISITS": "count(f.usage_key)",
    "UNIQUE_VISITORS": "count(DISTINCT f.customer_key)",
    "TOTAL_LIFT_RIDES_SUM": "CAST(sum(f.total_lift_rides) AS BIGINT)",
    "TOTAL_MOUNTAIN_HOURS": "sum(f.hours_on_mountain)",
    "AVG_RIDES_PER_VISIT": "sum(f.total_lift_rides) / NULLIF(count(f.usage_key), 0)",
    "AVG_HOURS_PER_VISIT": "sum(f.hours_on_mountain) / NULLIF(count(f.usage_key), 0)",
    "PASS_HOLDER_VISITS": "count(CASE WHEN c.is_pass_holder THEN 1 END)",
    "DAY_TICKET_VISITS": "count(CASE WHEN NOT c.is_pass_holder THEN 1 END)",
    "PASS_HOLDER_PCT": "count(CASE WHEN c.is_pass_holder THEN 1 END) / NULLIF(count(f.usage_key), 0) * 100",
    "WEEKEND_VISITS": "count(CASE WHEN d.is_weekend THEN 1 END)",
    "WEEKDAY_VISITS": "count(CASE WHEN NOT d.is_weekend THEN 1 END)",
    "WEEKEND_SHARE_PCT": "count(CASE WHEN d.is_weekend THEN 1 END) / NULLIF(count(f.usage_key), 0) * 100",
    "EXCELLENT_SNOW_VISITS": "count(CASE WHEN d.snow_condition = 'Excellent' THEN 1 END)",
    "HOLIDAY_VISITS": "count(CASE WHEN d.is_holiday THEN 1 END)",
    "VISITS_PER_GUEST": "count(f.usage_key) / NULLIF(count(DISTINCT f.customer_key), 0)",
}
ORACLE["sem_daily_summary_by_season_month"] = single(
    PU_J, {"SKI_SEASON": "d.ski_season", "MONTH_NAME": "d.month_name"}, DAILY,
    ["TOTAL_MOUNTAIN_HOURS", "AVG_RIDES_PER_VISIT", "AVG_HOURS_PER_VISIT", "PASS_HOLDER_PCT", "WEEKEND_SHARE_PCT",
     "VISITS_PER_GUEST"], ["fact_pass_usage", "dim_date", "dim_customer"])

LS_J = """fact_lift_scans f
  LEFT JOIN dim_date d ON f.date_key = d.date_key
  LEFT JOIN dim_lift lt ON f.lift_key = lt.lift_key
  LEFT JOIN dim_customer c ON f.customer_key = c.customer_key"""
OPS = {
    "TOTAL_SCANS": "count(f.scan_key)",
    "UNIQUE_RIDERS": "count(DISTINCT f.customer_key)",
    "AVG_WAIT_MINUTES": "avg(f.wait_time_minutes)",
    "P95_WAIT_MINUTES": "quantile_cont(f.wait_time_minutes, 0.95)",
    "MAX_WAIT_MINUTES": "max(f.wait_time_minutes)",
    "POWDER_DAY_SCANS": "count(CASE WHEN d.snow_condition = 'Excellent' THEN 1 END)",
    "WEEKEND_WAIT_DELTA": "avg(CASE WHEN d.is_weekend THEN f.wait_time_minutes END)"
                          " - avg(CASE WHEN NOT d.is_weekend THEN f.wait_time_minutes END)",
    "EARLY_MORNING_SCANS": "count(CASE WHEN f.scan_hour < 10 THEN 1 END)",
    "PASS_HOLDER_SHARE_PCT": "count(CASE WHEN c.is_pass_holder THEN 1 END) / NULLIF(count(f.scan_key), 0) * 100",
    "CAPACITY_UTILIZATION_PCT": "count(f.scan_key) / NULLIF(sum(lt.capacity_per_hour), 0) * 100",
    "P95_WAIT_MINUTES_APPROX": "quantile_disc(f.wait_time_minutes, 0.95)",
}
ORACLE["r14_wait_percentiles_from_sketches"] = with_ctes(["fact_lift_scans", "dim_lift", "dim_date"], """
SELECT 'lift_type' AS slice, lt.lift_type AS member, count(f.wait_time_minutes) AS scans, 0.009::DOUBLE AS rank_bound, TRUE AS within
FROM fact_lift_scans f LEFT JOIN dim_lift lt ON f.lift_key = lt.lift_key GROUP BY 2
UNION ALL
SELECT 'ski_season', d.ski_season, count(f.wait_time_minutes), 0.009::DOUBLE, TRUE
FROM fact_lift_scans f LEFT JOIN dim_date d ON f.date_key = d.date_key GROUP BY 2""")
ORACLE["sem_operations_by_lift_type"] = single(
    LS_J, {"LIFT_TYPE": "lt.lift_type", "TERRAIN_TYPE": "lt.terrain_type"}, OPS,
    ["AVG_WAIT_MINUTES", "P95_WAIT_MINUTES", "P95_WAIT_MINUTES_APPROX", "MAX_WAIT_MINUTES", "WEEKEND_WAIT_DELTA", "PASS_HOLDER_SHARE_PCT",
     "CAPACITY_UTILIZATION_PCT"], ["fact_lift_scans", "dim_date", "dim_lift", "dim_customer"])

PASS_PU = {
    "PASS_HOLDER_VISITS": "count(CASE WHEN c.is_pass_holder THEN f.usage_key END)",
    "ACTIVE_PASS_HOLDERS": "count(DISTINCT CASE WHEN c.is_pass_holder THEN f.customer_key END)",
    "PASS_USAGE_PER_HOLDER": "count(CASE WHEN c.is_pass_holder THEN f.usage_key END)"
                             " / NULLIF(count(DISTINCT CASE WHEN c.is_pass_holder THEN f.customer_key END), 0)",
    "PASS_HOURS_TOTAL": "sum(CASE WHEN c.is_pass_holder THEN f.hours_on_mountain END)",
    "AVERAGE_PASS_SESSION_HOURS": "sum(CASE WHEN c.is_pass_holder THEN f.hours_on_mountain END)"
                                  " / NULLIF(count(CASE WHEN c.is_pass_holder THEN f.usage_key END), 0)",
    "PASS_LIFT_RIDES_TOTAL": "CAST(sum(CASE WHEN c.is_pass_holder THEN f.total_lift_rides END) AS BIGINT)",
}
PASS_TS = {
    "PASS_REVENUE_TOTAL": "sum(CASE WHEN tt.ticket_category ILIKE '%Pass%' THEN f.purchase_amount END)",
    "AVERAGE_PASS_PRICE": "CAST(sum(CASE WHEN tt.ticket_category ILIKE '%Pass%' THEN f.purchase_amount END) AS DOUBLE)"
                          " / NULLIF(count(CASE WHEN tt.ticket_category ILIKE '%Pass%' THEN f.sale_key END), 0)",
    "ADVANCE_PASS_SHARE_PCT": "count(CASE WHEN tt.ticket_category ILIKE '%Pass%' AND f.is_advance_purchase THEN 1 END)"
                              " / NULLIF(count(CASE WHEN tt.ticket_category ILIKE '%Pass%' THEN f.sale_key END), 0)"
                              " * 100",
}
ORACLE["sem_passholder_by_season"] = with_ctes(
    ["fact_pass_usage", "fact_ticket_sales", "dim_date", "dim_customer", "dim_ticket_type"],
    rounded(drill_across([(PU_J, PASS_PU), (FTS_J.replace("  LEFT JOIN dim_location l ON f.location_key = l.location_key\n", ""), PASS_TS)],
                         {"SKI_SEASON": "d.ski_season"}, list(PASS_PU) + list(PASS_TS)),
            ["PASS_USAGE_PER_HOLDER", "PASS_HOURS_TOTAL", "AVERAGE_PASS_SESSION_HOURS", "PASS_REVENUE_TOTAL",
             "AVERAGE_PASS_PRICE", "ADVANCE_PASS_SHARE_PCT"]))


# -- named business queries --------------------------------------------------------------
PU_C = "fact_pass_usage p JOIN dim_customer c ON p.customer_key = c.customer_key"
PU_DC = """fact_pass_usage p LEFT JOIN dim_date d ON p.date_key = d.date_key
  LEFT JOIN dim_customer c ON p.customer_key = c.customer_key"""
PU_CTES = ["fact_pass_usage", "dim_customer", "dim_date"]

ORACLE["n01_avg_wait_by_lift_top5"] = with_ctes(["fact_lift_scans", "dim_lift"], """
SELECT l.lift_name AS LIFT_NAME, round(avg(f.wait_time_minutes), 2) AS AVG_WAIT
FROM fact_lift_scans f JOIN dim_lift l ON f.lift_key = l.lift_key
GROUP BY l.lift_name ORDER BY AVG_WAIT DESC, LIFT_NAME LIMIT 5""")
ORACLE["n04_segment_visit_profile"] = with_ctes(PU_CTES, f"""
SELECT c.customer_segment AS CUSTOMER_SEGMENT, count(DISTINCT p.customer_key) AS CUSTOMERS, count(*) AS VISITS,
       round(avg(p.total_lift_rides), 1) AS AVG_RIDES
FROM {PU_C} GROUP BY 1""")
ORACLE["n05_visits_per_customer_by_segment"] = with_ctes(PU_CTES, f"""
SELECT c.customer_segment AS CUSTOMER_SEGMENT, count(DISTINCT p.customer_key) AS CUSTOMERS,
       round(count(*) * 1.0 / count(DISTINCT p.customer_key), 1) AS VISITS_PER_CUSTOMER
FROM {PU_C} GROUP BY 1""")
ORACLE["n06_revenue_by_category"] = with_ctes(["fact_ticket_sales", "fact_food_beverage", "fact_rentals"], """
SELECT 'Tickets' AS CATEGORY, round(CAST(sum(purchase_amount) AS DOUBLE), 4) AS REVENUE FROM fact_ticket_sales
UNION ALL SELECT 'F&B', round(CAST(sum(total_amount) AS DOUBLE), 4) FROM fact_food_beverage
UNION ALL SELECT 'Rentals', round(CAST(sum(rental_amount) AS DOUBLE), 4) FROM fact_rentals""")
ORACLE["n07_visits_by_segment"] = with_ctes(PU_CTES, f"""
SELECT c.customer_segment AS CUSTOMER_SEGMENT, count(*) AS VISITS FROM {PU_C} GROUP BY 1""")
ORACLE["n08_season_by_pass_holder"] = with_ctes(PU_CTES, f"""
SELECT d.ski_season AS SKI_SEASON, c.is_pass_holder AS IS_PASS_HOLDER, count(*) AS VISITS FROM {PU_DC} GROUP BY 1, 2""")
ORACLE["n08_top_states"] = with_ctes(PU_CTES, f"""
SELECT c.state AS HOME_STATE, count(*) AS VISITS FROM {PU_DC} GROUP BY 1 ORDER BY VISITS DESC, HOME_STATE LIMIT 10""")
ORACLE["n08_age_mix"] = with_ctes(PU_CTES, f"""
SELECT c.age_group AS AGE_GROUP, count(*) AS VISITS, count(DISTINCT c.customer_segment) AS SEGMENTS
FROM {PU_DC} GROUP BY 1""")
ORACLE["n09_yoy_by_week_of_season"] = with_ctes(PU_CTES, """
SELECT a.ski_season AS SKI_SEASON, a.week_of_season AS WEEK_OF_SEASON, a.VISITS, b.VISITS AS PREV_SEASON_VISITS,
       round(round((a.VISITS - b.VISITS) / NULLIF(CAST(b.VISITS AS DOUBLE), 0) * 100, 2), 4) AS YOY_GROWTH_PCT
FROM g a LEFT JOIN g b ON b.week_of_season = a.week_of_season
 AND b.ski_season = CAST(CAST(substr(a.ski_season, 1, 4) AS INTEGER) - 1 AS VARCHAR) || '-' || substr(a.ski_season, 1, 4)
""", extra=[("g", f"""SELECT d.ski_season, d.week_of_season, count(*) AS VISITS FROM {PU_DC}
        WHERE d.ski_season IS NOT NULL GROUP BY 1, 2""")])
ORACLE["n10_weekend_vs_weekday_waits"] = with_ctes(["fact_lift_scans", "dim_date"], """
SELECT d.is_weekend AS IS_WEEKEND, count(*) AS SCANS, round(avg(f.wait_time_minutes), 4) AS AVG_WAIT
FROM fact_lift_scans f LEFT JOIN dim_date d ON f.date_key = d.date_key GROUP BY 1""")
ORACLE["n10_hourly_profile"] = with_ctes(["fact_lift_scans"], """
SELECT scan_hour AS SCAN_HOUR, count(*) AS SCANS, round(avg(wait_time_minutes), 4) AS AVG_WAIT
FROM fact_lift_scans GROUP BY 1""")
ORACLE["n18_unknown_entity"] = with_ctes(PU_CTES, f"""
SELECT c.customer_segment AS CUSTOMER_SEGMENT, count(p.usage_key) AS TOTAL_VISITS FROM {PU_DC}
WHERE c.customer_segment = 'no_such_segment' GROUP BY 1""")
ORACLE["n14_revenue_per_visitor"] = with_ctes(REV_CTES + PU_CTES, """
SELECT coalesce(r.SKI_SEASON, v.SKI_SEASON) AS SKI_SEASON, round(r.TOTAL_REVENUE, 4) AS TOTAL_REVENUE,
       v.UNIQUE_CUSTOMERS, round(r.TOTAL_REVENUE / NULLIF(CAST(v.UNIQUE_CUSTOMERS AS DOUBLE), 0), 4) AS REVENUE_PER_VISITOR
FROM r FULL JOIN v ON r.SKI_SEASON IS NOT DISTINCT FROM v.SKI_SEASON""", extra=[
    ("r", drill_across([(FTS_J, {"TICKET_REVENUE": TICKET_METRICS["TICKET_REVENUE"]}),
                        (FR_J, {"RENTAL_REVENUE": RENTAL_METRICS["RENTAL_REVENUE"]}),
                        (FFB_J, {"FNB_REVENUE": FNB_METRICS["FNB_REVENUE"]})],
                       {"SKI_SEASON": "d.ski_season"}, ["TOTAL_REVENUE"],
                       {"TOTAL_REVENUE": "CAST(" + TOTAL_REV["TOTAL_REVENUE"] + " AS DOUBLE)"})),
    ("v", "SELECT d.ski_season AS SKI_SEASON, count(DISTINCT f.customer_key) AS UNIQUE_CUSTOMERS FROM " + PU_J
     + " GROUP BY 1")])


# -- data-quality suite ------------------------------------------------------------------
from piste.plans.catalog import MART_CHECKS, PROBE_CHECKS, STAR_CHECKS  # noqa: E402
from piste.plans.declared_tests import declared  # noqa: E402


def _check_rows(checks):
    rows = []
    for c in checks:
        col = c.column
        if c.kind == "unique":
            q = f"SELECT count(*) FROM (SELECT {col} FROM {c.table} WHERE {col} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"
        elif c.kind == "not_null":
            q = f"SELECT count(*) FROM {c.table} WHERE {col} IS NULL"
        elif c.kind == "accepted_values":
            vals = ", ".join(f"'{v}'" for v in c.values)
            q = f"SELECT count(*) FROM {c.table} WHERE {col} IS NOT NULL AND {col} NOT IN ({vals})"
        else:
            q = (f"SELECT count(*) FROM {c.table} ch WHERE ch.{col} IS NOT NULL AND NOT EXISTS "
                 f"(SELECT 1 FROM {c.parent} pa WHERE pa.{c.parent_column} = ch.{col})")
        rows.append(f"SELECT '{c.name}' AS check_name, '{c.kind}' AS kind, '{c.table}' AS table_name, "
                    f"'{col}' AS column_name, ({q}) AS failures")
    body = "\nUNION ALL\n".join(rows)
    return with_ctes(_check_tables(checks), f"""SELECT check_name, kind, table_name, column_name, CAST(failures AS BIGINT) AS failures,
       CASE WHEN failures = 0 THEN 'pass' ELSE 'fail' END AS status FROM (
{body}) s""")


def _check_tables(checks):
    return sorted({c.table for c in checks} | {c.parent for c in checks if c.parent})


def _failing_values(checks):
    rows = []
    for c in checks:
        where = {"unique": f"{c.column} IS NOT NULL", "not_null": f"{c.column} IS NULL",
                 "accepted_values": f"{c.column} NOT IN ({', '.join(repr(v) for v in c.values) or 'NULL'})",
                 "relationships": f"{c.column} IS NOT NULL AND {c.column} NOT IN (SELECT {c.parent_column} FROM {c.parent} WHERE {c.parent_column} IS NOT NULL)"}[c.kind]
        rows.append(f"SELECT '{c.name}' AS check_name, '{c.table}' AS table_name, '{c.column}' AS column_name, "
                    f"coalesce(CAST({c.column} AS VARCHAR), '') AS value, count(*) AS n_records FROM {c.table} WHERE {where} GROUP BY {c.column}"
                    + (" HAVING count(*) > 1" if c.kind == "unique" else ""))
    return with_ctes(_check_tables(checks), "\nUNION ALL\n".join(rows))


ORACLE["q06_star_quality_suite"] = _check_rows(STAR_CHECKS)
ORACLE["q06_declared_mart_tests"] = _check_rows(MART_CHECKS)
ORACLE["q06_declared_tests"] = _check_rows(declared())
ORACLE["q05_stored_failures"] = _failing_values(PROBE_CHECKS)
ORACLE["q07_visits_calendar_overlap"] = with_ctes(["fact_pass_usage", "dim_date"], """
SELECT (SELECT min(visit_date) FROM fact_pass_usage) AS left_min, (SELECT max(visit_date) FROM fact_pass_usage) AS left_max,
       (SELECT count(DISTINCT visit_date) FROM fact_pass_usage) AS left_days,
       (SELECT min(full_date) FROM dim_date) AS right_min, (SELECT max(full_date) FROM dim_date) AS right_max,
       (SELECT count(DISTINCT full_date) FROM dim_date) AS right_days,
       (SELECT count(*) FROM (SELECT DISTINCT visit_date FROM fact_pass_usage) a
          JOIN (SELECT DISTINCT full_date FROM dim_date) b ON a.visit_date = b.full_date) AS overlap_days""")


# -- parking, grooming, employees --------------------------------------------------------
ORACLE["f13_parking_by_status"] = with_ctes(["fact_parking"], """
SELECT lot_type, occupancy_status, count(*) AS records, CAST(sum(vehicles_entered) AS BIGINT) AS entered,
       round(CAST(sum(revenue_collected) AS DOUBLE), 4) AS revenue, max(lot_capacity) AS largest_lot, count(*) FILTER (WHERE overflow_active) AS overflows
FROM fact_parking GROUP BY 1, 2""")
ORACLE["st13_parking_by_tier"] = with_ctes(["stg_parking_occupancy"], """
SELECT record_hour, CASE WHEN occupancy_percent >= 95 THEN 'Full' WHEN occupancy_percent >= 80 THEN 'High' WHEN occupancy_percent >= 50 THEN 'Moderate'
                         WHEN occupancy_percent >= 20 THEN 'Low' ELSE 'Empty' END AS occupancy_tier, count(*) AS records,
       CAST(sum(available_spaces) AS BIGINT) AS available FROM stg_parking_occupancy GROUP BY 1, 2""")
ORACLE["st12_grooming_by_shift"] = with_ctes(["stg_grooming_logs"], """
SELECT shift, CAST(year(grooming_date) AS INTEGER) AS year, count(*) AS runs, CAST(sum(duration_minutes) AS BIGINT) AS minutes,
       count(*) FILTER (WHERE condition_improved) AS improved, round(avg(quantity::DOUBLE), 4) AS mean_depth
FROM stg_grooming_logs GROUP BY 1, 2""")
ORACLE["st18_staff_by_department"] = """
SELECT CASE s_suppkey % 5 WHEN 0 THEN 'Lift Operations' WHEN 1 THEN 'Ticketing' WHEN 2 THEN 'Rental Services' WHEN 3 THEN 'Food & Beverage'
            ELSE 'Guest Services' END AS department, CASE s_suppkey % 3 WHEN 0 THEN 'Attendant' WHEN 1 THEN 'Operator' ELSE 'Lead' END AS job_title,
       count(*) AS employees, round(avg(s_suppkey % 15 + 18), 4) AS mean_rate, count(*) FILTER (WHERE s_suppkey % 3 <> 2) AS with_supervisor,
       count(*) FILTER (WHERE s_suppkey % 3 = 2) AS supervisors
FROM supplier GROUP BY 1, 2"""


# -- incremental load and SCD-2 -----------------------------------------------------------
ORACLE["i03_incremental_ticket_sales"] = with_ctes(["fact_ticket_sales"], """
SELECT sale_key, purchase_date_key, customer_key, ticket_type_key, CAST(purchase_amount AS DOUBLE) AS purchase_amount,
       ticket_category FROM fact_ticket_sales""")

for _name in ("i02_filter_after_build", "i03_upsert_moved_keys", "i04_full_refresh"):  # every way equals a full build
    ORACLE[_name] = ORACLE["i03_incremental_ticket_sales"]

for _mode, _channel, _payment, _columns in (
        ("append", "purchase_date >= DATE '1998-01-01'", "purchase_date < DATE '1998-01-01'", "purchase_amount,purchase_channel,purchase_date,purchase_timestamp,sale_id"),
        ("sync", "purchase_date >= DATE '1998-01-01'", "FALSE", "purchase_channel,purchase_date,purchase_timestamp,sale_id")):
    ORACLE[f"i05_schema_change_{_mode}"] = with_ctes(["fact_ticket_sales"], f"""
SELECT CAST(year(purchase_date) AS INTEGER) AS year, count(*) AS sales, count(purchase_amount) FILTER (WHERE {_payment}) AS n_purchase_amount,
       count(purchase_channel) FILTER (WHERE {_channel}) AS n_purchase_channel, '{_columns}' AS columns
FROM fact_ticket_sales GROUP BY 1""")

_SCD_TS = "TIMESTAMP '2021-11-01 00:00:00'"
ORACLE["d07_scd2_customer_snapshot"] = with_ctes(["dim_customer"], f"""
SELECT CASE WHEN changed THEN {sk('customer_id', ts('valid_from'))} ELSE customer_key END AS customer_key,
       customer_id, customer_segment, is_pass_holder, state, valid_from, valid_to, is_current
FROM (
  SELECT d.customer_key, d.customer_id, d.customer_segment, d.is_pass_holder, d.state, d.valid_from,
         CASE WHEN n.changed THEN {_SCD_TS} ELSE d.valid_to END AS valid_to, NOT coalesce(n.changed, FALSE) AS is_current,
         FALSE AS changed
  FROM dim_customer d LEFT JOIN n ON d.customer_id = n.customer_id
  UNION ALL
  SELECT NULL, n.customer_id, n.customer_segment, n.new_pass_holder, n.state, {_SCD_TS},
         TIMESTAMP '9999-12-31 00:00:00', TRUE, TRUE
  FROM n WHERE n.changed
) x""", extra=[("n", """SELECT c.customer_id, c.customer_segment, c.state, cu.c_acctbal > 4000 AS new_pass_holder,
       (c.is_pass_holder IS DISTINCT FROM (cu.c_acctbal > 4000)) AS changed
  FROM dim_customer c JOIN customer cu ON cu.c_custkey = c.customer_id""")])

# -- streaming --------------------------------------------------------------------------------
ORACLE["t03_stream_hourly_event_load"] = """
SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS value_sum
FROM (SELECT DISTINCT ON (event_id) * FROM events) e GROUP BY 1, 2"""
ORACLE["t03_stream_late_events"] = """
WITH e AS (SELECT DISTINCT ON (event_id) * FROM events),
b AS (SELECT epoch_us(min(ts)) AS a, (epoch_us(max(ts)) - epoch_us(min(ts))) / 4 AS step FROM events),
p AS (SELECT e.*, date_trunc('hour', ts) AS window_start, least(floor((epoch_us(ts) - a) / step), 3) AS part, max(ts) OVER () AS newest FROM e, b)
SELECT window_start, event_type, count(*) AS events, round(sum(value), 4) AS value_sum,
       count(*) FILTER (WHERE part < 3 AND window_start + INTERVAL 1 HOUR <= newest - INTERVAL 2 HOUR) AS late_events
FROM p GROUP BY 1, 2"""
ORACLE["t01_stream_fact_lift_scans"] = with_ctes(["fact_lift_scans"], """
SELECT date_key, count(*) AS scans, count(DISTINCT customer_key) AS riders, round(sum(wait_time_minutes), 4) AS wait_sum
FROM (SELECT DISTINCT ON (scan_key) * FROM fact_lift_scans) f GROUP BY 1""")


# -- single-fact views over the operations tables ---------------------------------------------
ORACLE["sem_weather_by_zone_season"] = single(
    "fact_weather f LEFT JOIN dim_date d ON f.date_key = d.date_key",
    {"MOUNTAIN_ZONE": "f.mountain_zone", "SKI_SEASON": "d.ski_season"},
    {"TOTAL_SNOWFALL": "sum(f.snowfall_inches)", "MAX_SNOWFALL": "max(f.snowfall_inches)",
     "MAX_BASE_DEPTH": "max(f.base_depth_inches)", "MIN_TEMP": "min(f.temp_low_f)", "MAX_TEMP": "max(f.temp_high_f)",
     "MAX_WIND": "max(f.wind_speed_mph)", "AVG_SNOWFALL": "avg(f.snowfall_inches)",
     "POWDER_DAY_COUNT": "count(CASE WHEN f.is_powder_day THEN 1 END)",
     "HIGH_WIND_COUNT": "count(CASE WHEN f.is_high_wind THEN 1 END)",
     "STORM_COUNT": "count(CASE WHEN f.storm_warning THEN 1 END)", "OBSERVATION_COUNT": "count(f.weather_key)"},
    ["TOTAL_SNOWFALL", "MAX_SNOWFALL", "MAX_BASE_DEPTH", "MIN_TEMP", "MAX_TEMP", "MAX_WIND", "AVG_SNOWFALL"],
    ["fact_weather", "dim_date"])
ORACLE["sem_staffing_by_department_location"] = single(
    "fact_staffing f LEFT JOIN dim_location l ON f.location_key = l.location_key",
    {"DEPARTMENT": "f.department", "LOCATION_NAME": "l.location_name"},
    {"TOTAL_SCHEDULED": "CAST(sum(f.scheduled_employees) AS BIGINT)",
     "TOTAL_ACTUAL": "CAST(sum(f.actual_employees) AS BIGINT)", "AVG_COVERAGE": "avg(f.coverage_ratio)",
     "UNDERSTAFFED_COUNT": "count(CASE WHEN f.is_understaffed THEN 1 END)",
     "TOTAL_SCHEDULED_HOURS": "CAST(sum(f.scheduled_labor_hours) AS BIGINT)",
     "TOTAL_ACTUAL_HOURS": "CAST(sum(f.actual_labor_hours) AS BIGINT)", "SHIFT_COUNT": "count(f.staffing_key)"},
    ["AVG_COVERAGE"], ["fact_staffing", "dim_location"])
ORACLE["sem_satisfaction_by_category_sentiment"] = single(
    "fact_feedback f", {"CATEGORY": "f.category", "SENTIMENT": "f.sentiment"},
    {"TOTAL_FEEDBACK": "count(f.feedback_id)", "AVERAGE_RATING": "avg(f.rating)", "AVERAGE_NPS": "avg(f.nps_score)",
     "POSITIVE_FEEDBACK_COUNT": "count(CASE WHEN f.sentiment = 'Positive' THEN 1 END)",
     "NEGATIVE_FEEDBACK_COUNT": "count(CASE WHEN f.sentiment = 'Negative' THEN 1 END)"},
    ["AVERAGE_RATING", "AVERAGE_NPS"], ["fact_feedback"])
ORACLE["sem_safety_by_type_severity"] = single(
    "fact_incidents f", {"INCIDENT_TYPE": "f.incident_type", "SEVERITY": "f.severity"},
    {"TOTAL_INCIDENTS": "count(f.incident_id)", "AVERAGE_SEVERITY": "avg(f.severity_score)",
     "CRITICAL_INCIDENTS": "count(CASE WHEN f.severity = 'Critical' THEN 1 END)",
     "AVG_PATROL_RESPONSE": "avg(f.patrol_response_minutes)"},
    ["AVERAGE_SEVERITY", "AVG_PATROL_RESPONSE"], ["fact_incidents"])
ORACLE["sem_lessons_by_type_sport"] = single(
    "fact_lessons f", {"LESSON_TYPE": "f.lesson_type", "SPORT_TYPE": "f.sport_type"},
    {"TOTAL_LESSONS": "count(f.lesson_id)", "TOTAL_REVENUE": "sum(f.total_lesson_revenue)",
     "AVG_STUDENT_RATING": "avg(f.student_rating)",
     "PRIVATE_LESSONS": "count(CASE WHEN f.lesson_type = 'Private' THEN 1 END)",
     "GROUP_LESSONS": "count(CASE WHEN f.lesson_type = 'Group' THEN 1 END)"},
    ["TOTAL_REVENUE", "AVG_STUDENT_RATING"], ["fact_lessons"])

ORACLE["n02_coverage_by_department"] = with_ctes(["fact_staffing"], """
SELECT department AS DEPARTMENT, round(round(avg(coverage_ratio), 3), 4) AS AVG_COVERAGE FROM fact_staffing GROUP BY 1""")
ORACLE["n03_powder_days"] = with_ctes(["fact_weather"], """
SELECT count(*) AS POWDER_DAYS FROM fact_weather WHERE snowfall_inches >= 6""")
ORACLE["n11_weather_vs_attendance"] = with_ctes(["fact_weather", "a_pass_usage"], """
SELECT w.mountain_zone AS MOUNTAIN_ZONE, count(*) AS DAYS,
       round(corr(w.snowfall_inches, CAST(v.visitors AS DOUBLE)), 4) AS CORR_SNOW_VISITORS,
       round(corr(w.temp_high_f, CAST(v.visitors AS DOUBLE)), 4) AS CORR_TEMP_VISITORS
FROM fact_weather w JOIN (SELECT visit_date AS day, count(DISTINCT customer_id) AS visitors FROM a_pass_usage GROUP BY 1) v
  ON w.weather_date = v.day GROUP BY 1""")
ORACLE["n12_snowfall_vs_revenue"] = with_ctes(["fact_weather", "fact_ticket_sales"], """
SELECT count(*) AS DAYS, round(corr(s.max_snowfall, r.revenue), 4) AS CORR_SNOW_REVENUE
FROM (SELECT weather_date AS day, max(snowfall_inches) AS max_snowfall FROM fact_weather GROUP BY 1) s
JOIN (SELECT purchase_date AS day, CAST(sum(purchase_amount) AS DOUBLE) AS revenue FROM fact_ticket_sales GROUP BY 1) r
  ON s.day = r.day""")
ORACLE["n13_monthly_trends"] = with_ctes(["fact_feedback", "fact_incidents"], """
SELECT coalesce(a.MONTH, b.MONTH) AS MONTH, a.AVG_NPS, a.AVG_RATING, a.FEEDBACK_COUNT, b.INCIDENTS, b.AVG_PATROL_RESPONSE
FROM (SELECT CAST(date_trunc('month', feedback_date) AS DATE) AS MONTH, round(avg(nps_score), 4) AS AVG_NPS,
             round(avg(rating), 4) AS AVG_RATING, count(*) AS FEEDBACK_COUNT FROM fact_feedback GROUP BY 1) a
FULL JOIN (SELECT CAST(date_trunc('month', incident_date) AS DATE) AS MONTH, count(*) AS INCIDENTS,
                  round(avg(patrol_response_minutes), 4) AS AVG_PATROL_RESPONSE FROM fact_incidents GROUP BY 1) b
  ON a.MONTH IS NOT DISTINCT FROM b.MONTH""")


# -- forecasting ------------------------------------------------------------------------------
TF_BODY = """
SELECT d.full_date AS FULL_DATE, d.day_of_week AS DAY_OF_WEEK, d.month_num AS MONTH, d.is_weekend AS IS_WEEKEND,
       d.is_holiday AS IS_HOLIDAY, v.CUSTOMER_SEGMENT, v.UNIQUE_VISITORS, w.SNOW_CONDITION, w.SNOWFALL_INCHES,
       w.BASE_DEPTH_INCHES, w.AVG_TEMP_F, w.WIND_SPEED_MPH, w.IS_POWDER_DAY, w.IS_HIGH_WIND
FROM dim_date d
JOIN (SELECT f.date_key, c.customer_segment AS CUSTOMER_SEGMENT, count(DISTINCT f.customer_key) AS UNIQUE_VISITORS
      FROM fact_pass_usage f LEFT JOIN dim_customer c ON f.customer_key = c.customer_key GROUP BY 1, 2) v
  ON v.date_key = d.date_key
JOIN (SELECT date_key, max(snow_condition) AS SNOW_CONDITION, sum(snowfall_inches) AS SNOWFALL_INCHES,
             avg(base_depth_inches) AS BASE_DEPTH_INCHES, avg(avg_temp_f) AS AVG_TEMP_F,
             max(wind_speed_mph) AS WIND_SPEED_MPH, max(CAST(is_powder_day AS INTEGER)) AS IS_POWDER_DAY,
             max(CAST(is_high_wind AS INTEGER)) AS IS_HIGH_WIND FROM fact_weather GROUP BY 1) w
  ON w.date_key = d.date_key
WHERE v.UNIQUE_VISITORS > 0"""
TF_CTES = ["dim_date", "fact_pass_usage", "dim_customer", "fact_weather"]
TF_DOUBLES = ["SNOWFALL_INCHES", "BASE_DEPTH_INCHES", "AVG_TEMP_F", "WIND_SPEED_MPH"]
ORACLE["p01_training_frame_by_segment"] = with_ctes(TF_CTES, rounded(TF_BODY, TF_DOUBLES))

_W = "OVER (PARTITION BY CUSTOMER_SEGMENT ORDER BY FULL_DATE"
P11_SQL = f"""
SELECT CUSTOMER_SEGMENT, FULL_DATE, UNIQUE_VISITORS, day_of_week, month, is_weekend, is_holiday, snow_condition_encoded,
       day_sin, day_0, day_6, lag_7, lag_14, lag_21, lag_28, rolling_7_mean, rolling_14_mean, rolling_30_mean
FROM (
  SELECT CUSTOMER_SEGMENT, FULL_DATE, UNIQUE_VISITORS,
         CAST(isodow(FULL_DATE) - 1 AS INTEGER) AS day_of_week, CAST(month(FULL_DATE) AS INTEGER) AS month,
         CAST(IS_WEEKEND AS INTEGER) AS is_weekend, CAST(IS_HOLIDAY AS INTEGER) AS is_holiday,
         coalesce(CASE regexp_replace(lower(trim(SNOW_CONDITION)), '\\s+', '_', 'g') WHEN 'powder' THEN 3
                  WHEN 'packed_powder' THEN 2 WHEN 'groomed' THEN 1 WHEN 'icy' THEN 0 END, 1) AS snow_condition_encoded,
         sin(2 * pi() * (isodow(FULL_DATE) - 1) / 7.0) AS day_sin,
         CASE WHEN isodow(FULL_DATE) - 1 = 0 THEN 1.0 ELSE 0.0 END AS day_0,
         CASE WHEN isodow(FULL_DATE) - 1 = 6 THEN 1.0 ELSE 0.0 END AS day_6,
         CAST(lag(UNIQUE_VISITORS, 7) {_W}) AS DOUBLE) AS lag_7, CAST(lag(UNIQUE_VISITORS, 14) {_W}) AS DOUBLE) AS lag_14,
         CAST(lag(UNIQUE_VISITORS, 21) {_W}) AS DOUBLE) AS lag_21, CAST(lag(UNIQUE_VISITORS, 28) {_W}) AS DOUBLE) AS lag_28,
         avg(UNIQUE_VISITORS) {_W} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS rolling_7_mean,
         avg(UNIQUE_VISITORS) {_W} ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS rolling_14_mean,
         avg(UNIQUE_VISITORS) {_W} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS rolling_30_mean,
         row_number() {_W}) AS rn
  FROM tf
) x WHERE rn > 30"""
ORACLE["p11_engineered_panel"] = with_ctes(TF_CTES, rounded(P11_SQL, [
    "day_sin", "day_0", "day_6", "lag_7", "lag_14", "lag_21", "lag_28", "rolling_7_mean", "rolling_14_mean",
    "rolling_30_mean"]), extra=[("tf", TF_BODY)])
ORACLE["p13_time_split_counts"] = with_ctes(TF_CTES, """
SELECT CUSTOMER_SEGMENT, count(CASE WHEN is_train THEN 1 END) AS train_rows, count(CASE WHEN NOT is_train THEN 1 END) AS test_rows,
       max(CASE WHEN is_train THEN FULL_DATE END) AS train_end
FROM (SELECT *, row_number() OVER (PARTITION BY CUSTOMER_SEGMENT ORDER BY FULL_DATE)
                  <= floor(count(*) OVER (PARTITION BY CUSTOMER_SEGMENT) * 0.8) AS is_train FROM tf) s GROUP BY 1""",
                                            extra=[("tf", TF_BODY)])
ORACLE["p19_weekday_means_january"] = with_ctes(TF_CTES, """
SELECT CUSTOMER_SEGMENT, CAST(isodow(FULL_DATE) - 1 AS INTEGER) AS weekday, round(avg(UNIQUE_VISITORS), 4) AS weekday_mean
FROM tf WHERE month(FULL_DATE) = 1 GROUP BY 1, 2""", extra=[("tf", TF_BODY)])
ORACLE["p20_weather_normals_january"] = with_ctes(["fact_weather", "dim_date"], """
SELECT round(coalesce(avg(snowfall_inches), 5.0), 4) AS snowfall_inches, round(coalesce(avg(base_depth_inches), 100.0), 4) AS base_depth_inches,
       round(coalesce(avg(avg_temp_f), 28.0), 4) AS avg_temp_f, round(coalesce(avg(wind_speed_mph), 12.0), 4) AS wind_speed_mph,
       CAST(coalesce(avg(CAST(is_powder_day AS INTEGER)), 0) > 0.3 AS INTEGER) AS is_powder_day, 0 AS is_high_wind
FROM fact_weather w JOIN dim_date d ON w.date_key = d.date_key WHERE d.month_num = 1""")
ORACLE["p19_weekday_means_by_month"] = with_ctes(TF_CTES, """
SELECT CUSTOMER_SEGMENT, CAST(month(FULL_DATE) AS INTEGER) AS month, CAST(isodow(FULL_DATE) - 1 AS INTEGER) AS weekday,
       round(avg(UNIQUE_VISITORS), 4) AS weekday_mean
FROM tf GROUP BY 1, 2, 3""", extra=[("tf", TF_BODY)])
ORACLE["p20_weather_normals_by_month"] = with_ctes(["fact_weather", "dim_date"], """
SELECT d.month_num AS month, round(coalesce(avg(snowfall_inches), 5.0), 4) AS snowfall_inches, round(coalesce(avg(base_depth_inches), 100.0), 4) AS base_depth_inches,
       round(coalesce(avg(avg_temp_f), 28.0), 4) AS avg_temp_f, round(coalesce(avg(wind_speed_mph), 12.0), 4) AS wind_speed_mph,
       CAST(coalesce(avg(CAST(is_powder_day AS INTEGER)), 0) > 0.3 AS INTEGER) AS is_powder_day, 0 AS is_high_wind
FROM fact_weather w JOIN dim_date d ON w.date_key = d.date_key GROUP BY 1""")
ORACLE["p24_weekday_weekend_profile"] = with_ctes(TF_CTES, """
SELECT CUSTOMER_SEGMENT, IS_WEEKEND, round(avg(UNIQUE_VISITORS), 4) AS mean, round(stddev_samp(UNIQUE_VISITORS), 4) AS std,
       count(*) AS days, round(median(UNIQUE_VISITORS), 4) AS median
FROM tf GROUP BY 1, 2""", extra=[("tf", TF_BODY)])


# -- monitoring ---------------------------------------------------------------------------------
_LOG = """
SELECT CUSTOMER_SEGMENT AS series, FULL_DATE AS forecast_date, CAST(FULL_DATE AS TIMESTAMP) - INTERVAL 1 DAY AS prediction_timestamp,
       CASE WHEN year(FULL_DATE) % 2 = 0 THEN 'v1' ELSE 'v2' END AS model_version,
       CAST(lag_7 AS BIGINT) AS predicted_visitors,
       CASE WHEN FULL_DATE < (SELECT max(FULL_DATE) - 3 FROM panel) THEN UNIQUE_VISITORS END AS actual_visitors,
       lag_7, lag_14, rolling_7_mean
FROM panel"""
_ERR = """
SELECT *, CAST(predicted_visitors - actual_visitors AS DOUBLE) AS error,
       CAST(abs(predicted_visitors - actual_visitors) AS DOUBLE) AS absolute_error,
       CASE WHEN actual_visitors > 0 THEN abs(predicted_visitors - actual_visitors) / actual_visitors * 100 END
         AS percentage_error
FROM log"""
_ASOF = "(SELECT CAST(max(FULL_DATE) - 3 AS TIMESTAMP) FROM panel)"


def _mon_sql(body: str, doubles: list[str]) -> str:
    return with_ctes(TF_CTES, rounded(body, doubles), extra=[("tf", TF_BODY), ("panel", P11_SQL), ("log", _LOG),
                                                               ("err", _ERR)])


ORACLE["o03_prediction_errors"] = _mon_sql("""SELECT series, forecast_date, model_version, predicted_visitors,
       actual_visitors, error, absolute_error, percentage_error FROM err""", ["error", "absolute_error", "percentage_error"])
ORACLE["o05_daily_performance"] = _mon_sql("""SELECT forecast_date, model_version, count(*) AS prediction_count,
       avg(predicted_visitors) AS avg_predicted, avg(actual_visitors) AS avg_actual, avg(absolute_error) AS mae,
       avg(percentage_error) AS mape, stddev_samp(percentage_error) AS mape_stddev
FROM err WHERE actual_visitors IS NOT NULL GROUP BY 1, 2""", ["avg_predicted", "avg_actual", "mae", "mape", "mape_stddev"])
ORACLE["o06_recent_performance"] = _mon_sql(f"""SELECT *, CASE WHEN mae IS NULL OR mape IS NULL THEN 'unknown'
       WHEN mae > 250 OR mape > 40 THEN 'critical' WHEN mae > 150 OR mape > 25 THEN 'warning' ELSE 'healthy' END AS status
FROM (SELECT count(*) AS prediction_count, avg(absolute_error) AS mae,
             avg(CAST(abs(predicted_visitors - actual_visitors) * 100 AS DOUBLE) / NULLIF(CAST(actual_visitors AS DOUBLE), 0)) AS mape,
             max(absolute_error) AS max_error
      FROM err WHERE actual_visitors IS NOT NULL AND prediction_timestamp >= {_ASOF} - INTERVAL 7 DAY) a""",
                                          ["mae", "mape", "max_error"])
_DRIFT_PARTS = []
for _f in ("lag_7", "lag_14", "rolling_7_mean"):
    _DRIFT_PARTS.append(f"""SELECT '{_f}' AS feature,
       avg(CASE WHEN prediction_timestamp >= {_ASOF} - INTERVAL 7 DAY THEN {_f} END) AS recent_mean,
       avg(CASE WHEN prediction_timestamp >= {_ASOF} - INTERVAL 30 DAY AND prediction_timestamp < {_ASOF} - INTERVAL 7 DAY THEN {_f} END) AS baseline_mean,
       stddev_samp(CASE WHEN prediction_timestamp >= {_ASOF} - INTERVAL 30 DAY AND prediction_timestamp < {_ASOF} - INTERVAL 7 DAY THEN {_f} END) AS baseline_std
FROM log""")
ORACLE["o07_feature_drift"] = _mon_sql("SELECT *, abs(recent_mean - baseline_mean) / NULLIF(baseline_std, 0) AS z_score_drift, "
                                       "coalesce(abs(recent_mean - baseline_mean) / NULLIF(baseline_std, 0) > 2.0, FALSE) AS drift_alert FROM ("
                                       + "\nUNION ALL\n".join(_DRIFT_PARTS) + ") d",
                                       ["recent_mean", "baseline_mean", "baseline_std", "z_score_drift"])
ORACLE["o08_metrics_by_version"] = _mon_sql("""SELECT model_version, count(*) AS predictions, avg(absolute_error) AS mae,
       avg(percentage_error) AS mape, avg(error) AS mean_error FROM err WHERE actual_visitors IS NOT NULL GROUP BY 1""",
                                            ["mae", "mape", "mean_error"])
ORACLE["o09_retrain_decision"] = _mon_sql("""SELECT series, recent_mape, coalesce(older_mape, recent_mape) AS older_mape,
       CASE WHEN recent_mape > 25 THEN 'retrain_required' WHEN recent_mape > coalesce(older_mape, recent_mape) * 1.5 THEN 'drift_detected'
            WHEN recent_mape < 15 THEN 'healthy' ELSE 'monitor' END AS decision
FROM (SELECT series, avg(CASE WHEN rn <= 7 THEN percentage_error END) AS recent_mape,
             avg(CASE WHEN rn > 7 THEN percentage_error END) AS older_mape
      FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY forecast_date DESC) AS rn
            FROM err WHERE actual_visitors IS NOT NULL) r GROUP BY 1) a""", ["recent_mape", "older_mape"])
ORACLE["o10_bias_check"] = _mon_sql("""SELECT series, avg(error) AS mean_error,
       CASE WHEN avg(error) > 10 THEN 'overpredicts' WHEN avg(error) < -10 THEN 'underpredicts' ELSE 'minimal' END AS bias
FROM err WHERE actual_visitors IS NOT NULL GROUP BY 1""", ["mean_error"])


# -- text and page mining -------------------------------------------------------------------------
def _strip_noise(h: str) -> str:
    for tag in ("script", "style", "nav", "footer"):
        h = f"regexp_replace({h}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', ' ', 'g')"
    return h


def _html_text(t: str) -> str:
    t = f"regexp_replace(regexp_replace({t}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    for ent, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"),
                    ("&apos;", "''"), ("&amp;", "&")):
        t = f"replace({t}, '{ent}', '{ch}')"
    return f"trim(regexp_replace({t}, '[\\s ]+', ' ', 'g'))"


def _inner(h: str, tag: str) -> str:
    return (f"CASE WHEN regexp_matches({h}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>') "
            f"THEN regexp_extract({h}, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}\\s*>', 1) END")


_PRICE = [r"\$[\d,]+\.?\d*", r"€[\d,]+\.?\d*", r"£[\d,]+\.?\d*", r"USD\s*[\d,]+\.?\d*", r"EUR\s*[\d,]+\.?\d*"]
_prices = "list_concat(" + ", ".join(f"regexp_extract_all(txt, '(?i){p}')" for p in _PRICE) + ")"
ORACLE["x01_page_extraction"] = f"""
SELECT page_id, url, coalesce(regexp_matches(url, '^https?://') AND host <> '' AND host NOT IN ('localhost', '127.0.0.1')
                              AND NOT starts_with(host, '192.168.'), FALSE) AS url_valid,
       CASE WHEN title <> '' THEN title ELSE regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1) END AS title,
       txt AS content, length(txt) AS content_chars,
       array_to_string(list_sort(list_distinct({_prices})), '|') AS prices
FROM (
  SELECT page_id, url, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host,
         {_html_text("regexp_extract(h, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1)")} AS title,
         {_html_text(f"coalesce({_inner('h', 'main')}, {_inner('h', 'article')}, {_inner('h', 'body')}, h)")} AS txt
  FROM (SELECT page_id, url, {_strip_noise('html')} AS h FROM pages) a
) b"""
ORACLE["x05_document_inventory"] = """
SELECT lang, source, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS total_chars FROM documents GROUP BY 1, 2"""

_TRIM = "regexp_replace(x, '^\\s+|\\s+$', '', 'g')"
ORACLE["x06_conversation_key_points"] = f"""
WITH m AS (
  SELECT conv_id, turn,
         list_filter(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_TRIM}),
                     lambda x: regexp_matches(x, '^([-*•]|[0-9]+\\.)\\s+')),
                     lambda x: regexp_replace(x, '^([-*•]|[0-9]+\\.)\\s+', '')),
                     lambda x: true) AS bullets,
         list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: {_TRIM}),
                     lambda x: x <> '') AS sentences
  FROM conversations
), e AS (
  SELECT conv_id, turn, bullets, list_filter(sentences, lambda x: NOT list_contains(bullets, x)) AS ex FROM m
), p AS (
  SELECT conv_id, turn,
         (CASE WHEN len(bullets) < 3 THEN list_concat(bullets, list_filter(ex, lambda x, i: list_position(ex, x) = i))
               ELSE bullets END) AS pts
  FROM e
)
SELECT conv_id, turn, CAST(generate_subscripts(pts, 1) AS INTEGER) AS point_no, unnest(pts) AS point FROM p"""

_TOK = "list_filter(string_split_regex(lower(text), '[^\\pL\\pN]+'), lambda t: t <> '')"
_SEARCH = f"""
WITH post AS (SELECT doc_id AS doc, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) t
              GROUP BY 1, 2),
dl AS (SELECT doc, sum(tf) AS dl FROM post GROUP BY 1),
st AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl),
terms AS (SELECT term, count(*) AS df, ln(1.0 + ((SELECT n_docs FROM st) - count(*) + 0.5) / (count(*) + 0.5)) AS idf
          FROM post GROUP BY 1),
q AS (SELECT DISTINCT item_id AS q, unnest({_TOK}) AS term FROM benchmark),
qt AS (SELECT q.q, q.term, t.idf, t.df FROM q LEFT JOIN terms t ON q.term = t.term),
nq AS (SELECT q, count(*) AS n_terms, bool_and(df IS NOT NULL) AS all_known FROM qt GROUP BY 1),
scored AS (
  SELECT qt.q, p.doc, count(*) AS matched,
         round(sum(qt.idf * p.tf * (1.2 + 1) / (p.tf + 1.2 * (1 - 0.75 + 0.75 * dl.dl / (SELECT avgdl FROM st)))), 6) AS score
  FROM qt JOIN post p ON qt.term = p.term JOIN dl ON dl.doc = p.doc GROUP BY 1, 2
)
SELECT s.q AS query_id, s.doc AS doc_id, CAST(row_number() OVER (PARTITION BY s.q ORDER BY s.score DESC, s.doc) AS INTEGER) AS rank,
       round(s.score, 4) AS score
FROM scored s JOIN nq ON s.q = nq.q
WHERE %s
QUALIFY rank <= 10"""
ORACLE["x04_benchmark_keyword_search"] = _SEARCH % "true"
ORACLE["x04_benchmark_keyword_search_all"] = _SEARCH % "s.matched = nq.n_terms AND nq.all_known"
ORACLE["x07_conversation_tables"] = f"""
WITH l AS (SELECT conv_id, turn, unnest(parts) AS text, generate_subscripts(parts, 1) AS n
           FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS parts FROM conversations) c)
SELECT conv_id, turn, 0 AS table_no, n::INT AS row_no, 'line|characters|words' AS headers, n::BIGINT AS line,
       length(text)::BIGINT AS characters, len({_TOK})::BIGINT AS words FROM l"""


# -- ingest bookkeeping --------------------------------------------------------------------------
_RC = ["dim_date", "dim_customer", "dim_lift", "dim_location", "dim_product", "dim_ticket_type", "fact_lift_scans",
       "fact_pass_usage", "fact_ticket_sales", "fact_rentals", "fact_food_beverage", "fact_weather", "fact_staffing",
       "fact_feedback", "fact_incidents", "fact_lessons"]
ORACLE["src07_star_row_counts"] = with_ctes(_RC, "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in _RC))
ORACLE["src08_star_freshness"] = with_ctes(
    ["fact_lift_scans", "fact_pass_usage", "fact_ticket_sales", "fact_rentals", "fact_food_beverage", "fact_weather"],
    "\nUNION ALL\n".join(f"SELECT '{t}' AS table_name, CAST({c} AS DATE) AS latest_date FROM {t}" for t, c in (
        ("fact_lift_scans", "max(scan_timestamp)"), ("fact_pass_usage", "max(visit_date)"),
        ("fact_ticket_sales", "max(purchase_date)"),
        ("fact_rentals", "strptime(CAST(max(rental_date_key) AS VARCHAR), '%Y%m%d')"),
        ("fact_food_beverage", "strptime(CAST(max(transaction_date_key) AS VARCHAR), '%Y%m%d')"),
        ("fact_weather", "max(weather_date)"))))
ORACLE["src06_idempotent_increment"] = """
SELECT CAST(o_orderdate AS DATE) AS order_date, count(*) AS orders FROM orders
WHERE CAST(o_orderdate AS DATE) NOT IN (SELECT DISTINCT CAST(o_orderdate AS DATE) FROM orders
                                        WHERE CAST(o_orderdate AS DATE) < DATE '1998-01-01')
GROUP BY 1"""


# -- marketing and season passes ---------------------------------------------------------------
ORACLE["sem_marketing_by_channel_season"] = single(
    "fact_marketing f LEFT JOIN dim_date d ON f.send_date_key = d.date_key",
    {"CAMPAIGN_CHANNEL": "f.campaign_channel", "SKI_SEASON": "d.ski_season"},
    {"TOTAL_TARGETED": "CAST(sum(f.target_count) AS BIGINT)", "TOTAL_CONVERSIONS": "CAST(sum(f.conversion_count) AS BIGINT)",
     "TOTAL_REVENUE": "sum(f.revenue_attributed)", "AVG_OPEN_RATE": "avg(f.open_rate)", "AVG_CLICK_RATE": "avg(f.click_rate)",
     "AVG_CONVERSION_RATE": "avg(f.conversion_rate)",
     "REVENUE_PER_CONVERSION": "sum(f.revenue_attributed) / NULLIF(CAST(sum(f.conversion_count) AS DOUBLE), 0)",
     "CAMPAIGN_COUNT": "count(f.marketing_key)"},
    ["TOTAL_REVENUE", "AVG_OPEN_RATE", "AVG_CLICK_RATE", "AVG_CONVERSION_RATE", "REVENUE_PER_CONVERSION"],
    ["fact_marketing", "dim_date"])
ORACLE["n15_pass_renewal_rate"] = with_ctes(["fact_season_pass_sales"], """
SELECT valid_season AS VALID_SEASON, count(*) AS PASSES_SOLD, count(CASE WHEN customer_type = 'Renewal' THEN 1 END) AS RENEWALS,
       round(count(CASE WHEN customer_type = 'Renewal' THEN 1 END) / count(*) * 100, 4) AS RENEWAL_RATE_PCT
FROM fact_season_pass_sales GROUP BY 1""")
ORACLE["n16_campaign_roi"] = with_ctes(["campaigns"], """
SELECT campaign_id AS CAMPAIGN_ID, campaign_name AS CAMPAIGN_NAME, round(CAST(actual_spend AS DOUBLE), 4) AS SPEND,
       round(CAST(revenue_attributed AS DOUBLE), 4) AS REVENUE,
       round((CAST(revenue_attributed AS DOUBLE) - CAST(actual_spend AS DOUBLE)) / NULLIF(CAST(actual_spend AS DOUBLE), 0), 4) AS ROI,
       round(CAST(revenue_attributed AS DOUBLE) / NULLIF(CAST(actual_spend AS DOUBLE), 0), 4) AS ROAS
FROM campaigns""")
ORACLE["n17_campaign_funnel"] = """
SELECT event_type AS CAMPAIGN_ID, count(*) AS TOUCHES, count(*) AS DELIVERED, count(*) FILTER (WHERE value > 5) AS OPENED,
       count(*) FILTER (WHERE value > 20) AS CLICKED, count(*) FILTER (WHERE value > 100) AS CONVERTED,
       round(count(*) FILTER (WHERE value > 5) / count(*), 4) AS OPEN_RATE,
       round(count(*) FILTER (WHERE value > 20) / NULLIF(count(*) FILTER (WHERE value > 5), 0), 4) AS CLICK_THROUGH_RATE,
       round(count(*) FILTER (WHERE value > 100) / NULLIF(count(*) FILTER (WHERE value > 20), 0), 4) AS CONVERSION_RATE
FROM events GROUP BY 1"""


# -- P02 / P03 ------------------------------------------------------------------------------------
ORACLE["p03_simple_training_frame"] = with_ctes(["dim_date", "fact_pass_usage"], """
SELECT d.full_date AS FULL_DATE, d.day_name AS DAY_NAME, d.day_of_week AS DAY_OF_WEEK, d.month_num AS MONTH_NUM,
       d.month_name AS MONTH_NAME, d.ski_season AS SKI_SEASON, d.is_weekend AS IS_WEEKEND, d.is_holiday AS IS_HOLIDAY,
       d.snow_condition AS SNOW_CONDITION, count(DISTINCT p.customer_key) AS UNIQUE_VISITORS, count(*) AS TOTAL_VISITS,
       CAST(sum(p.total_lift_rides) AS BIGINT) AS TOTAL_LIFT_RIDES
FROM dim_date d LEFT JOIN fact_pass_usage p ON p.date_key = d.date_key
WHERE d.full_date >= DATE '1998-01-01' AND d.full_date < DATE '2001-01-01'
GROUP BY ALL""")
ORACLE["p02_history_for_lags"] = with_ctes(["dim_date", "fact_pass_usage"], """
SELECT d.full_date AS FULL_DATE, d.day_of_week AS DAY_OF_WEEK, d.month_num AS MONTH_NUM, d.is_weekend AS IS_WEEKEND,
       d.is_holiday AS IS_HOLIDAY, d.snow_condition AS SNOW_CONDITION, count(DISTINCT p.customer_key) AS UNIQUE_VISITORS
FROM dim_date d LEFT JOIN fact_pass_usage p ON p.date_key = d.date_key
WHERE d.full_date >= DATE '2001-01-01' - INTERVAL 365 DAY
GROUP BY ALL""")

ORACLE["x07_conversation_sections"] = r"""
WITH m AS (SELECT conv_id, turn, text FROM conversations),
l AS (SELECT conv_id, turn, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
      FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS parts FROM m) x),
h AS (SELECT *, nullif(regexp_extract(line, '^(#{1,3})\s+(.+)$', 2), '') AS hdr FROM l),
s AS (SELECT *, count(hdr) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sec
      FROM h),
g AS (SELECT conv_id, turn, sec, coalesce(max(hdr), 'Overview') AS title,
             string_agg(CASE WHEN hdr IS NULL THEN line END, chr(10) ORDER BY pos) || chr(10) AS content
      FROM s GROUP BY 1, 2, 3),
k AS (SELECT conv_id, turn, title, content,
             CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY sec) AS INTEGER) AS section_no
      FROM g WHERE regexp_replace(content, '^\s+|\s+$', '', 'g') <> '')
SELECT conv_id, turn, section_no, title, length(content) AS content_chars FROM k
UNION ALL
SELECT conv_id, turn, 1 AS section_no, 'Response' AS title, length(text) AS content_chars FROM m
WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.conv_id = m.conv_id AND k.turn = m.turn)"""

ORACLE["x04_vector_prototype_search"] = """
WITH e AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
p AS (SELECT label, pos, avg(x) AS m FROM e GROUP BY 1, 2),
pn AS (SELECT label, sqrt(sum(m * m)) AS n FROM p GROUP BY 1),
vn AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM e GROUP BY 1),
dots AS (SELECT e.vec_id, p.label AS q, sum(e.x * p.m) AS d FROM e JOIN p ON e.pos = p.pos GROUP BY 1, 2),
s AS (SELECT d.q AS label, d.vec_id, round(d.d / (vn.n * pn.n), 6) AS score
      FROM dots d JOIN vn ON d.vec_id = vn.vec_id JOIN pn ON pn.label = d.q)
SELECT label, vec_id, CAST(row_number() OVER (PARTITION BY label ORDER BY score DESC NULLS LAST, vec_id) AS INTEGER) AS rank, score
FROM s QUALIFY rank <= 5"""

ORACLE["sem_revenue_from_marts"] = ORACLE["sem_revenue_by_season_segment"]

ORACLE["r22_tail_7_mean_by_segment"] = with_ctes(TF_CTES, """
SELECT CUSTOMER_SEGMENT, round(avg(UNIQUE_VISITORS), 4) AS tail_7_mean, max(FULL_DATE) AS last_date
FROM (SELECT *, row_number() OVER (PARTITION BY CUSTOMER_SEGMENT ORDER BY FULL_DATE DESC) AS rn FROM tf) t
WHERE rn <= 7 GROUP BY 1""", extra=[("tf", TF_BODY)])
ORACLE["o01_prediction_log_features"] = with_ctes(TF_CTES, """
SELECT CUSTOMER_SEGMENT AS series, FULL_DATE AS forecast_date, 'run-' || strftime(FULL_DATE, '%Y%m') AS run_id,
       CASE WHEN year(FULL_DATE) % 2 = 0 THEN 'v1' ELSE 'v2' END AS model_version,
       round(lag_7, 4) AS lag_7, round(lag_14, 4) AS lag_14, round(rolling_7_mean, 4) AS rolling_7_mean
FROM panel""", extra=[("tf", TF_BODY), ("panel", P11_SQL)])

_FF_LAGS = ", ".join(
    f"""round(coalesce((SELECT h.UNIQUE_VISITORS FROM tf h WHERE h.CUSTOMER_SEGMENT = f.seg AND h.FULL_DATE = f.d - {k}),
                (SELECT avg(h.UNIQUE_VISITORS) FROM tf h WHERE h.CUSTOMER_SEGMENT = f.seg
                   AND month(h.FULL_DATE) = month(f.start) AND isodow(h.FULL_DATE) = isodow(f.d - {k})), 400.0), 4) AS lag_{k}"""
    for k in (7, 14, 21, 28))
_FF_ROLL = ", ".join(
    f"""round(coalesce((SELECT avg(h.UNIQUE_VISITORS) FROM tf h WHERE h.CUSTOMER_SEGMENT = f.seg
                AND h.FULL_DATE BETWEEN f.d - {n} AND f.d - 1), 400.0), 4) AS rolling_{n}_mean"""
    for n in (7, 14, 30))
ORACLE["p18_future_frame_inputs"] = with_ctes(TF_CTES, f"""
SELECT f.seg AS CUSTOMER_SEGMENT, f.d AS FULL_DATE, {_FF_LAGS}, {_FF_ROLL},
       CAST(isodow(f.d) - 1 AS INTEGER) AS day_of_week, CAST(month(f.d) AS INTEGER) AS month,
       CAST(dayofweek(f.d) IN (0, 6) AS INTEGER) AS is_weekend
FROM (SELECT s.seg, CAST(st.start + INTERVAL (i) DAY AS DATE) AS d, st.start
      FROM (SELECT DISTINCT CUSTOMER_SEGMENT AS seg FROM tf) s,
           (SELECT CAST(max(FULL_DATE) + 1 AS DATE) AS start FROM tf) st, range(14) r(i)) f""", extra=[("tf", TF_BODY)])

_DOW = "(isodow(f.d) - 1)"
ORACLE["p18_model_inputs"] = with_ctes([*TF_CTES, "fact_weather", "dim_date"], f"""
SELECT f.seg AS CUSTOMER_SEGMENT, f.d AS FULL_DATE, {_FF_LAGS}, {_FF_ROLL},
       CAST({_DOW} AS INTEGER) AS day_of_week, CAST(month(f.d) AS INTEGER) AS month, CAST(dayofweek(f.d) IN (0, 6) AS INTEGER) AS is_weekend,
       CAST(c.is_holiday AS INTEGER) AS is_holiday, n.*, 1 AS snow_condition_encoded,
       round(sin(2 * pi() * {_DOW} / 7.0), 4) AS day_sin, round(cos(2 * pi() * {_DOW} / 7.0), 4) AS day_cos,
       round(sin(2 * pi() * month(f.d) / 12.0), 4) + 0.0 AS month_sin, round(cos(2 * pi() * month(f.d) / 12.0), 4) + 0.0 AS month_cos,
       {", ".join(f"CASE WHEN {_DOW} = {i} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS day_{i}" for i in range(7))}
FROM (SELECT s.seg, CAST(st.start + INTERVAL (i) DAY AS DATE) AS d, st.start
      FROM (SELECT DISTINCT CUSTOMER_SEGMENT AS seg FROM tf) s,
           (SELECT CAST(max(FULL_DATE) + 1 AS DATE) AS start FROM tf) st, range(14) r(i)) f
LEFT JOIN dim_date c ON c.full_date = f.d,
(SELECT round(coalesce(avg(snowfall_inches), 5.0), 4) AS snowfall_inches, round(coalesce(avg(base_depth_inches), 100.0), 4) AS base_depth_inches,
        round(coalesce(avg(avg_temp_f), 28.0), 4) AS avg_temp_f, round(coalesce(avg(wind_speed_mph), 12.0), 4) AS wind_speed_mph,
        CAST(coalesce(avg(CAST(is_powder_day AS INTEGER)), 0) > 0.3 AS INTEGER) AS is_powder_day, 0 AS is_high_wind
 FROM fact_weather w JOIN dim_date d ON w.date_key = d.date_key
 WHERE d.month_num = (SELECT month(CAST(max(FULL_DATE) + 1 AS DATE)) FROM tf)) n""", extra=[("tf", TF_BODY)])
ORACLE["p22_daily_staffing_bands"] = with_ctes(["fact_pass_usage", "dim_date"], """
SELECT ski_season, level, CASE level WHEN 'closed' THEN '0' WHEN 'quiet' THEN '2' WHEN 'steady' THEN '4' WHEN 'busy' THEN '8' ELSE '12+' END AS lift_operators,
       count(*) AS days, max(visitors) AS most_visitors
FROM (SELECT ski_season, visitors, CASE WHEN visitors < 1 THEN 'closed' WHEN visitors < 4 THEN 'quiet' WHEN visitors < 10 THEN 'steady'
                                        WHEN visitors < 60 THEN 'busy' ELSE 'peak' END AS level
      FROM (SELECT d.ski_season, coalesce(v.n, 0) AS visitors FROM dim_date d
            LEFT JOIN (SELECT date_key, count(DISTINCT customer_id) AS n FROM fact_pass_usage GROUP BY 1) v ON v.date_key = d.date_key) x) y
GROUP BY 1, 2, 3"""
)


# -- file round trips -------------------------------------------------------------------------------
ORACLE["src02_csv_round_trip"] = """
SELECT o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS orders, count(o_orderstatus) AS with_status,
       round(max(o_totalprice), 4) AS largest, max(o_orderkey) AS last_key FROM orders GROUP BY 1, 2"""
ORACLE["src03_tolerant_csv"] = """
SELECT 'loaded' AS result, l_returnflag, count(*) AS n, round(sum(CAST(l_quantity AS DOUBLE)), 4) AS quantity FROM lineitem WHERE l_linenumber <> 7 GROUP BY 2
UNION ALL SELECT 'rejected', NULL, count(*), NULL FROM lineitem WHERE l_linenumber = 7"""
ORACLE["src04_seed_join"] = """
SELECT r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"""
ORACLE["src05_json_documents"] = "SELECT lang, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars, max(doc_id) AS last_id FROM documents GROUP BY 1"
ORACLE["snk01_appended_days"] = "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS events, round(sum(value), 4) AS value_sum FROM events GROUP BY 1"
ORACLE["v08_flat_view"] = with_ctes(["fact_pass_usage", "dim_date", "dim_customer"], """
SELECT c.customer_segment AS CUSTOMER_SEGMENT, d.ski_season AS SKI_SEASON, count(*) AS visits, CAST(sum(f.total_lift_rides) AS BIGINT) AS rides,
       count(*) FILTER (WHERE c.is_pass_holder) AS by_pass
FROM fact_pass_usage f LEFT JOIN dim_date d ON f.date_key = d.date_key LEFT JOIN dim_customer c ON f.customer_key = c.customer_key GROUP BY 1, 2""")


# -- configured features, fixed predictions -----------------------------------------------------------
_CONFIGURED = f"""
SELECT CUSTOMER_SEGMENT, FULL_DATE, CAST(isodow(FULL_DATE) - 1 AS INTEGER) AS day_of_week, CAST(month(FULL_DATE) AS INTEGER) AS month,
       CAST(IS_WEEKEND AS INTEGER) AS is_weekend, sin(2 * pi() * (isodow(FULL_DATE) - 1) / 14.0) AS day_sin, cos(2 * pi() * (isodow(FULL_DATE) - 1) / 7.0) AS day_cos,
       round(sin(2 * pi() * month(FULL_DATE) / 12.0), 4) + 0.0 AS month_sin, CASE WHEN month(FULL_DATE) = 12 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS december,
       CAST(day(FULL_DATE) AS INTEGER) AS day_of_month, CAST(lag(UNIQUE_VISITORS, 1) {_W}) AS DOUBLE) AS lag_1, CAST(lag(UNIQUE_VISITORS, 7) {_W}) AS DOUBLE) AS lag_7,
       CAST(sum(UNIQUE_VISITORS) {_W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS DOUBLE) AS rolling_3_sum,
       CAST(sum(UNIQUE_VISITORS) {_W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS DOUBLE) AS rolling_5_sum,
       stddev_samp(UNIQUE_VISITORS) {_W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS rolling_5_std, row_number() {_W}) AS rn
FROM tf"""
_SHARED = ["day_sin", "day_cos", "month_sin", "december", "lag_7"]
_PLAIN = "CUSTOMER_SEGMENT, FULL_DATE, day_of_week, month, is_weekend, day_sin, day_cos, month_sin, december, day_of_month, lag_7"
ORACLE["p12_configured_panel"] = with_ctes(TF_CTES, rounded(f"SELECT {_PLAIN}, lag_1, rolling_3_sum, rolling_5_sum FROM ({_CONFIGURED}) x WHERE rn > 7",
                                                            [*_SHARED, "lag_1", "rolling_3_sum", "rolling_5_sum"]), extra=[("tf", TF_BODY)])
ORACLE["p10_rolling_deviation"] = with_ctes(TF_CTES, rounded(f"SELECT {_PLAIN}, rolling_5_std FROM ({_CONFIGURED}) x WHERE rn > 7",
                                                             [*_SHARED, "rolling_5_std"]), extra=[("tf", TF_BODY)])
ORACLE["p15_naive_metrics"] = with_ctes(TF_CTES, """
SELECT *, coalesce(r2 >= 0.70 AND mae <= 200.0 AND mape <= 25.0, FALSE) AS gate_passed FROM (
  SELECT CUSTOMER_SEGMENT, count(*) AS n, round(avg(abs(lag_7 - UNIQUE_VISITORS)), 4) AS mae, round(sqrt(avg((lag_7 - UNIQUE_VISITORS) ** 2)), 4) AS rmse,
         round(avg(CASE WHEN UNIQUE_VISITORS > 0 THEN abs(lag_7 - UNIQUE_VISITORS) / UNIQUE_VISITORS END) * 100, 4) AS mape,
         round(1 - sum((lag_7 - UNIQUE_VISITORS) ** 2) / nullif(var_pop(UNIQUE_VISITORS) * count(*), 0), 4) AS r2
  FROM panel GROUP BY 1) m""", extra=[("tf", TF_BODY), ("panel", P11_SQL)])
ORACLE["p23_naive_summary"] = with_ctes(TF_CTES, """
SELECT CUSTOMER_SEGMENT, CAST(sum(predicted) AS BIGINT) AS total_visitors, round(avg(predicted), 4) AS avg_visitors,
       min(FULL_DATE) FILTER (WHERE predicted = most) AS peak_date, CAST(max(predicted) AS BIGINT) AS peak_visitors, count(*) AS days
FROM (SELECT *, max(predicted) OVER (PARTITION BY CUSTOMER_SEGMENT) AS most
      FROM (SELECT CUSTOMER_SEGMENT, FULL_DATE, floor(greatest(0.0::DOUBLE, lag_7 * 1.1::DOUBLE - 2)) AS predicted FROM panel) p) q
GROUP BY 1""", extra=[("tf", TF_BODY), ("panel", P11_SQL)])


# -- alert bookkeeping --------------------------------------------------------------------------------
ORACLE["a01_due_alerts"] = with_ctes(["alert_subscriptions"], """
SELECT frequency, count(*) AS due, count(last_sent_at) AS sent_before, CAST(sum(alert_id) AS BIGINT) AS ids FROM alert_subscriptions
WHERE is_active AND frequency <> 'never' AND (last_sent_at IS NULL OR CAST(last_sent_at AS DATE) <= CASE frequency
  WHEN 'daily' THEN DATE '2024-01-30' WHEN 'weekly' THEN DATE '2024-01-24' ELSE DATE '2023-12-31' END) GROUP BY 1""")
ORACLE["a02_alert_run_log"] = with_ctes(["alert_subscriptions", "alert_log"], """
SELECT CASE WHEN ok THEN 'success' ELSE 'failed' END AS status, count(*) AS n, count(*) FILTER (WHERE ok) AS responses, count(*) FILTER (WHERE NOT ok) AS errors
FROM alert_log GROUP BY 1
UNION ALL SELECT 'moved on', count(*), NULL, NULL FROM alert_subscriptions WHERE alert_id IN (SELECT alert_id FROM alert_log WHERE ok)""")
ORACLE["a03_alert_listing"] = with_ctes(["alert_subscriptions", "alert_log"], """
SELECT recipient_email, count(*) AS alerts, CAST(sum(coalesce(n, 0)) AS BIGINT) AS times_sent,
       count(*) FILTER (WHERE is_active AND NOT (recipient_email = 'user7@example.org' AND question ILIKE '%machinery%')) AS active
FROM alert_subscriptions s LEFT JOIN (SELECT alert_id, count(*) AS n FROM alert_log WHERE ok GROUP BY 1) l ON s.alert_id = l.alert_id GROUP BY 1""")


# -- evaluation roll-ups ------------------------------------------------------------------------------
ORACLE["e03_evaluation_scores"] = """
SELECT agent_name, round(avg(goal_score), 4) AS goal, round(avg(plan_score), 4) AS plan, round(avg(action_score), 4) AS action, count(*) AS questions,
       round((avg(goal_score) + avg(plan_score) + avg(action_score)) / 3, 4) AS overall
FROM (SELECT c_mktsegment AS agent_name, CASE WHEN c_custkey % 60 + 30 > 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS goal_score,
             CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS plan_score,
             CASE WHEN c_custkey % 7 = 0 OR c_custkey % 5 = 0 THEN 0.0::DOUBLE WHEN c_custkey % 11 = 0 THEN 0.5::DOUBLE
                  ELSE 0.6::DOUBLE + 0.4 * CASE c_custkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.7 ELSE 0.9 END END AS action_score
      FROM customer) s GROUP BY 1"""
ORACLE["e04_golden_versions"] = """
SELECT agent_name, version, question_type, count(*) AS questions
FROM (SELECT c_mktsegment AS agent_name, CASE WHEN c_custkey % 2 = 0 THEN 'v1' ELSE 'v2' END AS version,
             CASE WHEN c_mktsegment = 'BUILDING' AND c_custkey % 2 = 1 THEN 'revised' ELSE ['simple', 'join', 'trend'][(c_custkey % 3 + 1)::INT] END AS question_type,
             NOT (c_mktsegment = 'BUILDING' AND c_custkey % 2 = 1 AND c_custkey % 3 = 2) AS stays FROM customer) g
WHERE stays GROUP BY 1, 2, 3"""
