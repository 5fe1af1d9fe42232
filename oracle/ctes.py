"""Star schema over the driver views, restated in DuckDB SQL.

Each entry is one CTE; ``with_ctes(names, body)`` emits the CTEs a query needs (in
dependency order) followed by the query body.  Written independently of the Spark code
from the same definitions, so the comparison checks both.
"""

from __future__ import annotations

NULL_TOKEN = "'_dbt_utils_surrogate_key_null_'"


def sk(*exprs: str) -> str:
    parts = ", ".join(f"coalesce(CAST({e} AS VARCHAR), {NULL_TOKEN})" for e in exprs)
    return f"md5(concat_ws('-', {parts}))"


def ts(e: str) -> str:
    return f"strftime({e}, '%Y-%m-%d %H:%M:%S.%g')"


def dkey(e: str) -> str:
    return f"CAST(year({e}) * 10000 + month({e}) * 100 + day({e}) AS INTEGER)"


LOAD = "TIMESTAMP '2020-11-01 00:00:00'"
CATALOG_FROM = "TIMESTAMP '2020-11-01 00:00:00'"
AS_OF = "DATE '2025-01-01'"
LINE_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
FNB_TOTAL = "CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2) AS DECIMAL(18,2))"
RENTAL_AMOUNT = ("CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 + CAST(l_tax AS DECIMAL(4,2)))"
                 " * CAST(0.01 AS DECIMAL(4,2)), 2) AS DECIMAL(18,2))")

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name, deps, sql):
    CTES[name] = (tuple(deps), sql)


cte("a_customers", [], f"""
SELECT c_custkey AS customer_id, c_name AS customer_name,
       make_date(CAST(1940 + c_custkey % 70 AS INTEGER), CAST(1 + c_custkey % 12 AS INTEGER),
                 CAST(1 + c_custkey % 28 AS INTEGER)) AS birth_date,
       c_mktsegment AS customer_segment, c_acctbal > 5000 AS is_pass_holder,
       CASE WHEN c_acctbal > 8000 THEN 'Epic' WHEN c_acctbal > 5000 THEN 'Local' END AS pass_type,
       n_name AS state, {LOAD} AS created_at
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")

cte("dim_customer", ["a_customers"], f"""
SELECT {sk('customer_id', ts('created_at'))} AS customer_key, customer_id, customer_name, birth_date,
       year({AS_OF}) - year(birth_date) AS age,
       CASE WHEN year({AS_OF}) - year(birth_date) < 18 THEN 'Child'
            WHEN year({AS_OF}) - year(birth_date) BETWEEN 18 AND 34 THEN 'Young Adult'
            WHEN year({AS_OF}) - year(birth_date) BETWEEN 35 AND 54 THEN 'Adult'
            WHEN year({AS_OF}) - year(birth_date) >= 55 THEN 'Senior' ELSE 'Unknown' END AS age_group,
       customer_segment, is_pass_holder, pass_type, state,
       created_at AS valid_from, TIMESTAMP '9999-12-31 00:00:00' AS valid_to, TRUE AS is_current
FROM a_customers""")

cte("dim_date", [], f"""
SELECT date_key, full_date, day_name, day_of_week, month_num, month_name, calendar_year, ski_season,
       season_month, week_of_season, is_weekend, is_holiday, holiday_name, snow_condition
FROM (
  SELECT {dkey('d')} AS date_key, d AS full_date, strftime(d, '%a') AS day_name,
         CAST(dayofweek(d) AS INTEGER) AS day_of_week, month(d) AS month_num, strftime(d, '%b') AS month_name,
         year(d) AS calendar_year,
         CASE WHEN month(d) >= 11 THEN CAST(year(d) AS VARCHAR) || '-' || CAST(year(d) + 1 AS VARCHAR)
              WHEN month(d) <= 4 THEN CAST(year(d) - 1 AS VARCHAR) || '-' || CAST(year(d) AS VARCHAR) END AS ski_season,
         CASE WHEN month(d) >= 11 THEN month(d) - 10 WHEN month(d) <= 4 THEN month(d) + 2 END AS season_month,
         CAST(CASE WHEN month(d) >= 11 THEN floor(date_diff('day', make_date(year(d), 11, 1), d) / 7) + 1
                   WHEN month(d) <= 4 THEN floor(date_diff('day', make_date(year(d) - 1, 11, 1), d) / 7) + 1
              END AS INTEGER) AS week_of_season,
         dayofweek(d) IN (0, 6) AS is_weekend,
         ((month(d) = 12 AND day(d) BETWEEN 20 AND 31) OR (month(d) = 1 AND day(d) BETWEEN 1 AND 5)
          OR (month(d) = 1 AND dayofweek(d) = 1 AND day(d) BETWEEN 15 AND 21)
          OR (month(d) = 2 AND dayofweek(d) = 1 AND day(d) BETWEEN 15 AND 21)
          OR (month(d) = 3 AND day(d) BETWEEN 10 AND 24)) AS is_holiday,
         CASE WHEN month(d) = 12 AND day(d) = 25 THEN 'Christmas' WHEN month(d) = 1 AND day(d) = 1 THEN 'New Years Day'
              WHEN month(d) = 7 AND day(d) = 4 THEN 'Independence Day'
              WHEN month(d) = 11 AND dayofweek(d) = 4 AND day(d) BETWEEN 22 AND 28 THEN 'Thanksgiving' END AS holiday_name,
         CASE WHEN month(d) IN (1, 2) THEN 'Excellent' WHEN month(d) IN (12, 3) THEN 'Good'
              WHEN month(d) IN (11, 4) THEN 'Fair' ELSE 'Closed' END AS snow_condition, until
  FROM (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d, until FROM (
    SELECT least(DATE '1994-11-01', min(day)) AS lo, greatest(DATE '1994-11-01' + 10999, max(day) + 60) AS hi, max(day) + 60 AS until FROM (
      SELECT CAST(o_orderdate AS DATE) AS day FROM orders UNION ALL SELECT CAST(l_shipdate AS DATE) FROM lineitem
      UNION ALL SELECT CAST(ts AS DATE) FROM events))) spine
) x
WHERE ski_season IS NOT NULL AND full_date <= greatest({AS_OF} + INTERVAL 24 MONTH, until)""")

cte("dim_ticket_type", [], f"""
SELECT {sk('ticket_type_id', ts(CATALOG_FROM))} AS ticket_type_key, ticket_type_id,
       CASE substr(ticket_type_id, 1, 1) WHEN '1' THEN 'season_pass' WHEN '2' THEN 'multi_day'
            WHEN '3' THEN 'day_pass' WHEN '4' THEN 'half_day' ELSE 'day_pass' END AS ticket_category,
       CAST(CASE substr(ticket_type_id, 1, 1) WHEN '1' THEN 899 WHEN '2' THEN 349 WHEN '3' THEN 129
            WHEN '4' THEN 89 ELSE 109 END AS DECIMAL(18,2)) AS price,
       {CATALOG_FROM} AS valid_from
FROM (SELECT DISTINCT o_orderpriority AS ticket_type_id FROM orders) t""")

cte("dim_product", [], f"""
SELECT {sk('p_partkey', ts(CATALOG_FROM))} AS product_key, p_partkey AS product_id, p_name AS product_name,
       p_brand AS product_category, p_type AS product_type, CAST(p_retailprice AS DECIMAL(18,2)) AS price, {CATALOG_FROM} AS valid_from
FROM part""")

cte("dim_location", [], f"""
SELECT {sk('n_nationkey')} AS location_key, CAST(n_nationkey AS BIGINT) AS location_id, n_name AS location_name,
       r_name AS location_type
FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""")

cte("dim_lift", [], f"""
SELECT {sk('s_suppkey')} AS lift_key, s_suppkey AS lift_id, s_name AS lift_name,
       CASE s_suppkey % 4 WHEN 0 THEN 'Gondola' WHEN 1 THEN 'Express Quad' WHEN 2 THEN 'Triple Chair'
            ELSE 'Surface Lift' END AS lift_type,
       CAST(1000 + 100 * (s_suppkey % 20) AS BIGINT) AS capacity_per_hour, r_name AS terrain_type,
       CASE WHEN s_acctbal < 0 THEN 'Beginner' WHEN s_acctbal < 5000 THEN 'Intermediate' ELSE 'Advanced' END
           AS difficulty_access
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")

cte("fact_ticket_sales", ["dim_customer", "dim_ticket_type"], f"""
SELECT {sk('o_orderkey')} AS sale_key, {dkey('CAST(o_orderdate AS DATE)')} AS purchase_date_key,
       {sk('o_custkey', ts('c.valid_from'))} AS customer_key, {sk('o_orderkey % 25')} AS location_key,
       {sk('o_orderpriority', ts('tt.valid_from'))} AS ticket_type_key,
       o_orderkey AS sale_id, o_custkey AS customer_id, o_orderpriority AS ticket_type_id,
       CAST(o_orderdate AS DATE) AS purchase_date, CAST(o_totalprice AS DECIMAL(18,2)) AS purchase_amount,
       CASE o_orderstatus WHEN 'F' THEN 'online' WHEN 'O' THEN 'window' WHEN 'P' THEN 'kiosk' END AS purchase_channel,
       CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INTEGER) > CAST(o_orderdate AS DATE)
         AND o_orderstatus IN ('F', 'O', 'P') AS is_advance_purchase,
       tt.ticket_category, tt.price AS list_price, tt.price - CAST(o_totalprice AS DECIMAL(18,2)) AS discount_amount
FROM orders
LEFT JOIN dim_customer c ON o_custkey = c.customer_id
LEFT JOIN dim_ticket_type tt ON o_orderpriority = tt.ticket_type_id""")

cte("a_pass_usage", [], """
SELECT concat_ws('-', o_custkey, strftime(CAST(o_orderdate AS DATE), '%Y%m%d')) AS usage_id,
       o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS visit_date,
       CAST(count(*) * 6 + o_custkey % 7 AS BIGINT) AS total_lift_rides,
       (count(*) * 6 + o_custkey % 5) / 4.0 AS hours_on_mountain
FROM orders GROUP BY o_custkey, CAST(o_orderdate AS DATE)""")

cte("fact_pass_usage", ["a_pass_usage", "dim_customer"], f"""
SELECT {sk('usage_id')} AS usage_key, {dkey('visit_date')} AS date_key,
       {sk('u.customer_id', ts('c.valid_from'))} AS customer_key,
       usage_id, u.customer_id, visit_date, total_lift_rides, hours_on_mountain,
       dayofweek(visit_date) IN (0, 6) AS is_weekend
FROM a_pass_usage u LEFT JOIN dim_customer c ON u.customer_id = c.customer_id""")

cte("line_orders", [], """
SELECT l.*, o_custkey FROM lineitem l JOIN orders ON l_orderkey = o_orderkey""")

cte("fact_lift_scans", ["line_orders", "dim_customer"], f"""
SELECT {sk(LINE_ID)} AS scan_key, {dkey('CAST(l_shipdate AS DATE)')} AS date_key,
       {sk('o_custkey', ts('c.valid_from'))} AS customer_key, {sk('l_suppkey')} AS lift_key,
       {LINE_ID} AS scan_id, o_custkey AS customer_id, l_suppkey AS lift_id,
       l_shipdate + to_hours(CAST(8 + (l_partkey + l_linenumber) % 9 AS INTEGER)) AS scan_timestamp,
       l_quantity / 2.0 AS wait_time_minutes,
       CAST(8 + (l_partkey + l_linenumber) % 9 AS INTEGER) AS scan_hour,
       CAST(dayofweek(l_shipdate) AS INTEGER) AS day_of_week
FROM line_orders LEFT JOIN dim_customer c ON o_custkey = c.customer_id""")

cte("fact_food_beverage", ["line_orders", "dim_customer", "dim_product"], f"""
SELECT {sk(LINE_ID)} AS transaction_key, {dkey('CAST(l_shipdate AS DATE)')} AS transaction_date_key,
       {sk('o_custkey', ts('c.valid_from'))} AS customer_key, {sk('l_suppkey % 25')} AS location_key,
       {sk('l_partkey', ts('p.valid_from'))} AS product_key,
       {LINE_ID} AS transaction_id, o_custkey AS customer_id, l_partkey AS product_id,
       CAST(l_quantity AS BIGINT) AS quantity,
       {FNB_TOTAL} AS total_amount,
       p.price AS list_price,
       {FNB_TOTAL} - CAST(l_quantity AS BIGINT) * p.price AS upsell_amount
FROM line_orders LEFT JOIN dim_customer c ON o_custkey = c.customer_id
LEFT JOIN dim_product p ON l_partkey = p.product_id""")

cte("fact_rentals", ["line_orders", "dim_customer", "dim_product"], f"""
SELECT {sk(LINE_ID)} AS rental_key, {dkey('CAST(l_shipdate AS DATE)')} AS rental_date_key,
       {sk('o_custkey', ts('c.valid_from'))} AS customer_key, {sk('l_suppkey % 25')} AS location_key,
       {sk('l_partkey', ts('p.valid_from'))} AS product_key,
       {LINE_ID} AS rental_id, o_custkey AS customer_id, l_partkey AS product_id,
       {RENTAL_AMOUNT} AS rental_amount,
       p.price AS list_price,
       {RENTAL_AMOUNT} - p.price AS rental_markup
FROM line_orders LEFT JOIN dim_customer c ON o_custkey = c.customer_id
LEFT JOIN dim_product p ON l_partkey = p.product_id
WHERE l_returnflag = 'R'""")


def with_ctes(names, body: str, extra: list[tuple[str, str]] = ()) -> str:
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    items = [(n, CTES[n][1]) for n in order] + list(extra)
    if not items:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({sql}\n)" for n, sql in items) + "\n" + body

# -- operations tables derived from the driver data ---------------------------------------
def pick(idx: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {idx} {arms} END"


ZONES = ["Summit Peak", "North Ridge", "Alpine Bowl", "Village Base"]
DEPTS = ["Lift Operations", "Ticketing", "Rental Services", "Food & Beverage", "Guest Services"]
INC_TYPES = ["collision", "fall", "equipment_failure", "medical", "lost_skier", "lift_issue"]
LESSON_TYPES = ["Private", "Semi_Private", "Group", "Kids_Camp", "Race_Clinic", "Freestyle_Camp"]

cte("a_weather", [], f"""
SELECT weather_date, {pick('zone', ZONES)} AS mountain_zone,
       CASE WHEN snow >= 6 THEN 'Powder' WHEN snow >= 3 THEN 'Packed Powder' WHEN snow >= 1 THEN 'Groomed' ELSE 'Icy' END
         AS snow_condition,
       snow AS snowfall_inches, CAST((qty * 3) // n AS DOUBLE) AS base_depth_inches, high AS temp_high_f,
       high - 12 AS temp_low_f, max_disc * 28 / 10.0 AS wind_speed_mph, max_disc >= 10 AS storm_warning
FROM (
  SELECT *, ((disc * 120) // n) / 100.0 AS snow, 15.0 + ((tax * 40) // n) / 10.0 AS high
  FROM (SELECT CAST(l_shipdate AS DATE) AS weather_date, CAST(l_suppkey % 4 AS INTEGER) AS zone, count(*) AS n,
               sum(CAST(round(l_discount * 100) AS BIGINT)) AS disc, sum(CAST(round(l_tax * 100) AS BIGINT)) AS tax,
               sum(CAST(l_quantity AS BIGINT)) AS qty, max(CAST(round(l_discount * 100) AS BIGINT)) AS max_disc
        FROM lineitem GROUP BY 1, 2) g
) x""")

cte("fact_weather", ["a_weather", "dim_date"], f"""
SELECT {sk("CAST(weather_date AS VARCHAR)", "mountain_zone")} AS weather_key, d.date_key, w.*,
       coalesce(snowfall_inches >= 6, FALSE) AS is_powder_day, coalesce(wind_speed_mph >= 25, FALSE) AS is_high_wind,
       (temp_high_f + temp_low_f) / 2 AS avg_temp_f, temp_high_f - temp_low_f AS temp_range_f
FROM a_weather w LEFT JOIN dim_date d ON w.weather_date = d.full_date""")

cte("fact_staffing", ["dim_date", "dim_location"], f"""
SELECT {sk('schedule_id')} AS staffing_key, d.date_key, l.location_key, s.*,
       coalesce(coverage_ratio < 0.9, FALSE) AS is_understaffed,
       scheduled_employees - actual_employees AS staff_variance,
       scheduled_employees * 9 AS scheduled_labor_hours, actual_employees * 9 AS actual_labor_hours
FROM (
  SELECT strftime(schedule_date, '%Y%m%d') || '-' || p AS schedule_id, CAST(substr(p, 1, 1) AS BIGINT) AS location_id,
         schedule_date, {pick('CAST(substr(p, 1, 1) AS INTEGER) - 1', DEPTS)} AS department, 'Staff' AS job_role,
         CAST(n + 2 AS INTEGER) AS scheduled_employees,
         CAST(n + 2 - CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS actual_employees,
         round((n + 2 - CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END) / (n + 2), 2) AS coverage_ratio
  FROM (SELECT CAST(o_orderdate AS DATE) AS schedule_date, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2) g
) s
LEFT JOIN dim_date d ON s.schedule_date = d.full_date
LEFT JOIN dim_location l ON s.location_id = l.location_id""")

cte("fact_feedback", ["a_customers"], """
SELECT f.*, c.customer_segment,
       CASE WHEN response_date IS NOT NULL THEN date_diff('day', feedback_date, response_date) END AS response_time_days
FROM (
  SELECT event_id AS feedback_id, user_id AS customer_id, CAST(ts AS DATE) AS feedback_date, event_type AS feedback_type,
         CASE event_id % 4 WHEN 0 THEN 'Lifts' WHEN 1 THEN 'Food' WHEN 2 THEN 'Rentals' WHEN 3 THEN 'Lessons' END AS category,
         CAST(floor(value) % 11 AS INTEGER) AS nps_score, CAST(event_id % 5 + 1 AS DOUBLE) AS rating,
         CASE WHEN CAST(floor(value) % 11 AS INTEGER) >= 9 THEN 'Positive'
              WHEN CAST(floor(value) % 11 AS INTEGER) >= 7 THEN 'Neutral' ELSE 'Negative' END AS sentiment,
         CASE WHEN event_id % 4 <> 0 THEN CAST(ts AS DATE) + CAST(event_id % 4 AS INTEGER) END AS response_date,
         event_id % 3 = 0 AS resolved
  FROM events
) f LEFT JOIN a_customers c ON f.customer_id = c.customer_id""")

cte("fact_incidents", ["a_customers"], f"""
SELECT i.*, c.customer_segment,
       CASE severity WHEN 'Minor' THEN 1 WHEN 'Moderate' THEN 2 WHEN 'Serious' THEN 3 WHEN 'Critical' THEN 4 ELSE 0 END
         AS severity_score
FROM (
  SELECT event_id AS incident_id, CAST(ts AS DATE) AS incident_date, {pick('event_id % 6', INC_TYPES)} AS incident_type,
         CASE WHEN value < 3 THEN 'Minor' WHEN value < 6 THEN 'Moderate' WHEN value < 20 THEN 'Serious' ELSE 'Critical' END
           AS severity,
         user_id AS customer_id, value > 8 AS transport_required,
         CAST(round(floor(value * 10) / 10.0) AS INTEGER) AS patrol_response_minutes
  FROM events WHERE event_type = 'error'
) i LEFT JOIN a_customers c ON i.customer_id = c.customer_id""")

cte("fact_lessons", ["a_customers"], f"""
SELECT l.*, c.customer_segment, s.s_name AS instructor_name,
       lesson_amount + coalesce(rental_amount, 0) + coalesce(tip_amount, 0) AS total_lesson_revenue
FROM (
  SELECT event_id AS lesson_id, user_id AS customer_id, CAST(ts AS DATE) AS lesson_date,
         {pick('event_id % 6', LESSON_TYPES)} AS lesson_type,
         CASE WHEN user_id % 2 = 0 THEN 'Ski' ELSE 'Snowboard' END AS sport_type, event_id % 40 AS instructor_id,
         CAST(value AS DECIMAL(18,2)) AS lesson_amount,
         CAST(CASE WHEN event_id % 2 = 0 THEN 25 END AS DECIMAL(18,2)) AS rental_amount,
         CAST(CASE WHEN event_id % 3 = 0 THEN 10 END AS DECIMAL(18,2)) AS tip_amount,
         CAST(event_id % 5 + 1 AS DOUBLE) AS student_rating
  FROM events WHERE event_type = 'purchase'
) l LEFT JOIN a_customers c ON l.customer_id = c.customer_id
LEFT JOIN supplier s ON l.instructor_id = s.s_suppkey""")


# -- marketing and season passes -------------------------------------------------------------
_CH = "CASE event_type WHEN 'click' THEN 'email' WHEN 'view' THEN 'social' WHEN 'purchase' THEN 'email' WHEN 'signup' THEN 'web' WHEN 'error' THEN 'sms' END"
cte("fact_marketing", ["dim_date"], f"""
SELECT {sk('touch_id')} AS marketing_key, d.date_key AS send_date_key, m.*,
       CASE WHEN target_count > 0 THEN CAST(revenue_attributed AS DOUBLE) / target_count ELSE 0 END AS revenue_per_target
FROM (
  SELECT strftime(send_date, '%Y%m%d') || '-' || event_type AS touch_id, event_type AS campaign_id,
         {_CH} AS campaign_channel, send_date, CAST(n * 10 AS INTEGER) AS target_count, CAST(conv AS INTEGER) AS conversion_count,
         round(opened / n, 4) AS open_rate, round(clicked / n, 4) AS click_rate,
         CAST(rev AS DOUBLE) AS revenue_attributed,
         CASE WHEN conv > 0 THEN CAST(rev AS DOUBLE) / conv ELSE 0 END AS revenue_per_conversion,
         CASE WHEN n * 10 > 0 THEN CAST(conv AS DOUBLE) / (n * 10) ELSE 0 END AS conversion_rate
  FROM (SELECT CAST(ts AS DATE) AS send_date, event_type, count(*) AS n, count(*) FILTER (WHERE value > 100) AS conv,
               count(*) FILTER (WHERE value > 5) AS opened, count(*) FILTER (WHERE value > 20) AS clicked,
               sum(CAST(value AS DECIMAL(18,2))) AS rev
        FROM events GROUP BY 1, 2) g
) m LEFT JOIN dim_date d ON m.send_date = d.full_date""")

cte("campaigns", [], """
SELECT event_type AS campaign_id, upper(substr(event_type, 1, 1)) || substr(event_type, 2) || ' Campaign' AS campaign_name,
       CAST(count(*) * CAST(2.5 AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS actual_spend,
       CAST(coalesce(sum(CASE WHEN value > 100 THEN CAST(value AS DECIMAL(18,2)) END), 0) AS DECIMAL(18,2)) AS revenue_attributed
FROM events GROUP BY 1""")

cte("fact_season_pass_sales", [], """
SELECT o_orderkey AS sale_id,
       CASE WHEN month(o_orderdate) >= 5 THEN CAST(year(o_orderdate) AS VARCHAR) || '-' || CAST(year(o_orderdate) + 1 AS VARCHAR)
            ELSE CAST(year(o_orderdate) - 1 AS VARCHAR) || '-' || CAST(year(o_orderdate) AS VARCHAR) END AS valid_season,
       CASE WHEN CAST(o_orderdate AS DATE) > f.first_date THEN 'Renewal' ELSE 'New' END AS customer_type
FROM orders o JOIN (SELECT o_custkey AS c, min(CAST(o_orderdate AS DATE)) AS first_date FROM orders
                    WHERE o_orderpriority = '1-URGENT' GROUP BY 1) f ON o.o_custkey = f.c
WHERE o_orderpriority = '1-URGENT'""")


# -- staging tables: the columns that declared tests look at ------------------------------------
cte("stg_lift_scans", ["line_orders"], f"""
SELECT {LINE_ID} AS scan_id, o_custkey AS customer_id, l_suppkey AS lift_id,
       l_shipdate + to_hours(CAST(8 + (l_partkey + l_linenumber) % 9 AS INTEGER)) AS scan_timestamp
FROM line_orders WHERE o_custkey IS NOT NULL AND l_suppkey IS NOT NULL AND l_shipdate IS NOT NULL""")
cte("stg_pass_usage", ["a_pass_usage"], "SELECT usage_id FROM a_pass_usage WHERE usage_id IS NOT NULL AND customer_id IS NOT NULL AND visit_date IS NOT NULL")
cte("stg_ticket_sales", [], "SELECT o_orderkey AS sale_id FROM orders WHERE o_orderkey IS NOT NULL")
cte("stg_rentals", ["line_orders"], f"SELECT {LINE_ID} AS rental_id FROM line_orders WHERE l_returnflag = 'R'")
cte("stg_food_beverage", ["line_orders"], f"SELECT {LINE_ID} AS transaction_id FROM line_orders")
cte("stg_weather_conditions", ["a_weather"], "SELECT weather_date, mountain_zone FROM a_weather")
cte("stg_staffing_schedule", [], """
SELECT DISTINCT strftime(CAST(o_orderdate AS DATE), '%Y%m%d') || '-' || o_orderpriority AS schedule_id FROM orders""")
cte("stg_marketing_touches", [], "SELECT DISTINCT strftime(CAST(ts AS DATE), '%Y%m%d') || '-' || event_type AS touch_id FROM events")
cte("stg_marketing_campaigns", [], "SELECT DISTINCT event_type AS campaign_id FROM events")
cte("stg_campaign_touches", [], "SELECT event_id AS touch_id FROM events")
cte("stg_season_pass_sales", [], "SELECT o_orderkey AS sale_id FROM orders WHERE o_orderpriority = '1-URGENT'")
cte("stg_ski_lessons", [], "SELECT event_id AS lesson_id FROM events WHERE event_type = 'purchase'")
cte("stg_incidents", ["fact_incidents"], "SELECT incident_id, incident_type, severity FROM fact_incidents")
cte("stg_customer_feedback", ["fact_feedback"], "SELECT feedback_id, sentiment FROM fact_feedback")
cte("stg_instructors", [], "SELECT s_suppkey AS instructor_id FROM supplier")

cte("stg_parking_occupancy", [], """
SELECT *, total_spaces - occupied_spaces AS available_spaces, round(occupied_spaces * 100.0::DOUBLE / total_spaces, 2) AS occupancy_percent
FROM (SELECT CAST(ts AS DATE) AS record_date, hour(ts)::INT AS record_hour, user_id % 25 AS lot_id, count(*) AS vehicles_entered,
             (user_id % 25 * 10 + 40)::INT AS total_spaces, least(user_id % 25 * 10 + 40, count(*) * 8)::INT AS occupied_spaces,
             sum(CAST(value AS DECIMAL(18,2))) AS revenue_collected
      FROM events GROUP BY 1, 2, 3, user_id % 25) g""")
cte("fact_parking", ["stg_parking_occupancy"], """
SELECT p.*, r_name AS lot_type, (n_nationkey * 10 + 40)::INT AS lot_capacity, occupied_spaces >= p.total_spaces AS overflow_active,
       CASE WHEN occupancy_percent >= 95 THEN 'Full' WHEN occupancy_percent >= 80 THEN 'Near Full' WHEN occupancy_percent >= 50 THEN 'Moderate'
            ELSE 'Light' END AS occupancy_status
FROM stg_parking_occupancy p LEFT JOIN nation ON n_nationkey = lot_id LEFT JOIN region ON n_regionkey = r_regionkey""")
cte("stg_grooming_logs", [], """
SELECT *, CASE machine_id % 2 WHEN 0 THEN 'night' ELSE 'early' END AS shift, n * 15 AS duration_minutes,
       quantity % 4 IN (0, 1, 2) AND n % 3 IN (0, 1) AS condition_improved
FROM (SELECT CAST(l_shipdate AS DATE) AS grooming_date, l_linenumber AS machine_id, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
      FROM lineitem GROUP BY 1, 2) g""")
cte("alert_subscriptions", [], """
SELECT c_custkey AS alert_id, 'user' || (c_custkey % 50) || '@example.org' AS recipient_email, 'Revenue of ' || lower(c_mktsegment) || ' customers' AS question,
       CASE c_custkey % 4 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' WHEN 2 THEN 'monthly' ELSE 'never' END AS frequency, c_custkey % 5 <> 0 AS is_active, last_sent_at
FROM customer LEFT JOIN (SELECT user_id, max(ts) AS last_sent_at FROM events GROUP BY 1) e ON c_custkey = user_id""")
cte("alert_log", [], "SELECT user_id AS alert_id, event_type <> 'error' AS ok FROM events WHERE event_id % 3 = 0")
