"""The eleven semantic views and their 97 metrics, declared with piste.plans.semantic.

Table sources name entries of the tables mapping passed to ``query`` (see
:class:`piste.plans.star.Star` for the driver-bound star schema).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from piste.functions.core import safe_div
from piste.plans.semantic import (
    DerivedMetric, Dimension, Metric, Relationship, RowFact, SemanticView, Table,
)


# -- expression helpers -------------------------------------------------------------
def count_(t, c):
    return lambda r: F.count(r(t, c))


def count_distinct(t, c):
    return lambda r: F.countDistinct(r(t, c))


def sum_(t, c):
    return lambda r: F.sum(r(t, c))


def avg_(t, c):
    return lambda r: F.avg(r(t, c).cast("double"))


def max_(t, c):
    return lambda r: F.max(r(t, c))


def min_(t, c):
    return lambda r: F.min(r(t, c))


def count_when(pred):
    return lambda r: F.count(F.when(pred(r), F.lit(1)))


def sum_when(pred, t, c):
    return lambda r: F.sum(F.when(pred(r), r(t, c)))


def ratio(num, den, pct=False):
    def build(r):
        v = safe_div(num(r), den(r))
        return v * 100 if pct else v
    return build


def flag(t, c):
    return lambda r: r(t, c)


def not_flag(t, c):
    return lambda r: ~r(t, c)


def equals(t, c, v):
    return lambda r: r(t, c) == F.lit(v)


def ilike(t, c, pattern):
    return lambda r: r(t, c).ilike(pattern)


# -- shared tables ------------------------------------------------------------------
DIM_DATE = Table("DIM_DATE", "dim_date", "date_key", ("calendar",), "One row per day, with its season, weekday and holiday flags")
DIM_CUSTOMER = Table("DIM_CUSTOMER", "dim_customer", "customer_key", ("customers",),
                     "Current and past versions of a customer: segment, age band, home state")
DIM_LIFT = Table("DIM_LIFT", "dim_lift", "lift_key", ("lifts",), "Lift attributes")
DIM_LOCATION = Table("DIM_LOCATION", "dim_location", "location_key", ("venues", "points_of_sale"),
                     "Places where something is sold, by type")
DIM_TICKET_TYPE = Table("DIM_TICKET_TYPE", "dim_ticket_type", "ticket_type_key", ("ticket_products",),
                        "Kinds of ticket and pass, with their price")
DIM_PRODUCT = Table("DIM_PRODUCT", "dim_product", "product_key", ("sku",), "What is rented out, eaten or drunk, by category")

FPU, FLS, FTS, FR, FFB = "FACT_PASS_USAGE", "FACT_LIFT_SCANS", "FACT_TICKET_SALES", "FACT_RENTALS", "FACT_FOOD_BEVERAGE"


def _date_dims(alias="DIM_DATE", names=("FULL_DATE", "SKI_SEASON")):
    cols = {
        "FULL_DATE": ("full_date", ()), "DAY_NAME": ("day_name", ()), "MONTH_NAME": ("month_name", ()),
        "CALENDAR_YEAR": ("calendar_year", ()), "SKI_SEASON": ("ski_season", ("season",)),
        "WEEK_OF_SEASON": ("week_of_season", ()), "SEASON_MONTH": ("season_month", ()),
        "IS_WEEKEND": ("is_weekend", ()), "IS_HOLIDAY": ("is_holiday", ()), "HOLIDAY_NAME": ("holiday_name", ()),
        "SNOW_CONDITION": ("snow_condition", ()),
    }
    return [Dimension(n, alias, cols[n][0], cols[n][1]) for n in names]


def _customer_dims(names):
    return [Dimension(n, "DIM_CUSTOMER", n.lower()) for n in names]


# -- sem_customer_behavior (11 metrics) -------------------------------------------
CUSTOMER_BEHAVIOR = SemanticView(
    name="sem_customer_behavior",
    comment="Visit behaviour of customers by persona, pass status and calendar",
    tables=[DIM_DATE, DIM_CUSTOMER, Table(FPU, "fact_pass_usage", "usage_key", ("visits",))],
    relationships=[Relationship("PASS_USAGE_TO_DATE", FPU, "date_key", "DIM_DATE"),
                   Relationship("PASS_USAGE_TO_CUSTOMER", FPU, "customer_key", "DIM_CUSTOMER")],
    facts=[RowFact("TOTAL_LIFT_RIDES", FPU, "total_lift_rides"), RowFact("HOURS_ON_MOUNTAIN", FPU, "hours_on_mountain"),
           RowFact("VISIT_IS_WEEKEND", FPU, "is_weekend")],
    dimensions=_date_dims(names=("FULL_DATE", "SKI_SEASON", "WEEK_OF_SEASON", "IS_WEEKEND", "IS_HOLIDAY",
                                 "SNOW_CONDITION"))
    + _customer_dims(("CUSTOMER_SEGMENT", "AGE_GROUP", "IS_PASS_HOLDER", "PASS_TYPE", "STATE")),
    metrics=[
        Metric("TOTAL_VISITS", FPU, count_(FPU, "usage_key")),
        Metric("UNIQUE_CUSTOMERS", FPU, count_distinct(FPU, "customer_key")),
        Metric("PASS_HOLDER_VISITS", FPU, count_when(flag("DIM_CUSTOMER", "is_pass_holder"))),
        Metric("WEEKEND_VISITS", FPU, count_when(flag("DIM_DATE", "is_weekend"))),
        Metric("PASS_HOURS_TOTAL", FPU, sum_(FPU, "hours_on_mountain")),
        Metric("TOTAL_LIFT_RIDES_SUM", FPU, sum_(FPU, "total_lift_rides")),
        Metric("VISITS_PER_CUSTOMER", FPU, ratio(count_(FPU, "usage_key"), count_distinct(FPU, "customer_key"))),
        Metric("PASS_RETENTION_PCT", FPU, ratio(
            lambda r: F.countDistinct(F.when(r("DIM_CUSTOMER", "is_pass_holder"), r(FPU, "customer_key"))),
            count_distinct(FPU, "customer_key"), pct=True)),
        Metric("WEEKEND_SHARE_PCT", FPU, ratio(count_when(flag("DIM_DATE", "is_weekend")),
                                               count_(FPU, "usage_key"), pct=True)),
        Metric("AVERAGE_HOURS_PER_VISIT", FPU, ratio(sum_(FPU, "hours_on_mountain"), count_(FPU, "usage_key"))),
        Metric("AVERAGE_LIFT_RIDES_PER_VISIT", FPU, ratio(sum_(FPU, "total_lift_rides"), count_(FPU, "usage_key"))),
    ],
)

# -- sem_daily_summary (15 metrics) ------------------------------------------------
DAILY_SUMMARY = SemanticView(
    name="sem_daily_summary",
    comment="Daily resort activity summary",
    tables=[DIM_DATE, DIM_CUSTOMER, Table(FPU, "fact_pass_usage", "usage_key")],
    relationships=[Relationship("PASS_USAGE_TO_DATE", FPU, "date_key", "DIM_DATE"),
                   Relationship("PASS_USAGE_TO_CUSTOMER", FPU, "customer_key", "DIM_CUSTOMER")],
    facts=[RowFact("TOTAL_LIFT_RIDES", FPU, "total_lift_rides"), RowFact("HOURS_ON_MOUNTAIN", FPU, "hours_on_mountain")],
    dimensions=_date_dims(names=("FULL_DATE", "DAY_NAME", "MONTH_NAME", "CALENDAR_YEAR", "SKI_SEASON",
                                 "WEEK_OF_SEASON", "SEASON_MONTH", "IS_WEEKEND", "IS_HOLIDAY", "HOLIDAY_NAME",
                                 "SNOW_CONDITION"))
    + _customer_dims(("CUSTOMER_SEGMENT", "IS_PASS_HOLDER", "PASS_TYPE", "AGE_GROUP", "STATE")),
    metrics=[
        Metric("TOTAL_VISITS", FPU, count_(FPU, "usage_key")),
        Metric("UNIQUE_VISITORS", FPU, count_distinct(FPU, "customer_key")),
        Metric("TOTAL_LIFT_RIDES_SUM", FPU, sum_(FPU, "total_lift_rides")),
        Metric("TOTAL_MOUNTAIN_HOURS", FPU, sum_(FPU, "hours_on_mountain")),
        Metric("AVG_RIDES_PER_VISIT", FPU, ratio(sum_(FPU, "total_lift_rides"), count_(FPU, "usage_key"))),
        Metric("AVG_HOURS_PER_VISIT", FPU, ratio(sum_(FPU, "hours_on_mountain"), count_(FPU, "usage_key"))),
        Metric("PASS_HOLDER_VISITS", FPU, count_when(flag("DIM_CUSTOMER", "is_pass_holder"))),
        Metric("DAY_TICKET_VISITS", FPU, count_when(not_flag("DIM_CUSTOMER", "is_pass_holder"))),
        Metric("PASS_HOLDER_PCT", FPU, ratio(count_when(flag("DIM_CUSTOMER", "is_pass_holder")),
                                             count_(FPU, "usage_key"), pct=True)),
        Metric("WEEKEND_VISITS", FPU, count_when(flag("DIM_DATE", "is_weekend"))),
        Metric("WEEKDAY_VISITS", FPU, count_when(not_flag("DIM_DATE", "is_weekend"))),
        Metric("WEEKEND_SHARE_PCT", FPU, ratio(count_when(flag("DIM_DATE", "is_weekend")),
                                               count_(FPU, "usage_key"), pct=True)),
        Metric("EXCELLENT_SNOW_VISITS", FPU, count_when(equals("DIM_DATE", "snow_condition", "Excellent"))),
        Metric("HOLIDAY_VISITS", FPU, count_when(flag("DIM_DATE", "is_holiday"))),
        Metric("VISITS_PER_GUEST", FPU, ratio(count_(FPU, "usage_key"), count_distinct(FPU, "customer_key"))),
    ],
)

# -- sem_operations (10 metrics) ---------------------------------------------------
OPERATIONS = SemanticView(
    name="sem_operations",
    comment="Lift operations: scans, waits, capacity",
    tables=[DIM_DATE, DIM_LIFT, DIM_CUSTOMER, Table(FLS, "fact_lift_scans", "scan_key", ("lift_scans",))],
    relationships=[Relationship("SCANS_TO_DATE", FLS, "date_key", "DIM_DATE"),
                   Relationship("SCANS_TO_LIFT", FLS, "lift_key", "DIM_LIFT"),
                   Relationship("SCANS_TO_CUSTOMER", FLS, "customer_key", "DIM_CUSTOMER")],
    facts=[RowFact("WAIT_TIME_MINUTES", FLS, "wait_time_minutes"), RowFact("TEMPERATURE_F", FLS, "temperature_f"),
           RowFact("SCAN_HOUR", FLS, "scan_hour"), RowFact("WEATHER_CONDITION", FLS, "weather_condition")],
    dimensions=_date_dims(names=("FULL_DATE", "DAY_NAME", "IS_WEEKEND", "IS_HOLIDAY", "SKI_SEASON", "SNOW_CONDITION"))
    + [Dimension(n, "DIM_LIFT", n.lower()) for n in ("LIFT_NAME", "LIFT_TYPE", "TERRAIN_TYPE", "DIFFICULTY_ACCESS",
                                                     "CAPACITY_PER_HOUR")]
    + _customer_dims(("CUSTOMER_SEGMENT", "IS_PASS_HOLDER")),
    metrics=[
        Metric("TOTAL_SCANS", FLS, count_(FLS, "scan_key")),
        Metric("UNIQUE_RIDERS", FLS, count_distinct(FLS, "customer_key")),
        Metric("AVG_WAIT_MINUTES", FLS, avg_(FLS, "wait_time_minutes")),
        # Exact interpolated percentile (state: a count per distinct value of the group); the bounded
        # variants are P95_WAIT_MINUTES_APPROX below and the daily sketches of operators/sketches.py.
        Metric("P95_WAIT_MINUTES", FLS, lambda r: F.percentile(r(FLS, "wait_time_minutes"), F.lit(0.95)), apart=True),
        Metric("MAX_WAIT_MINUTES", FLS, max_(FLS, "wait_time_minutes")),
        Metric("POWDER_DAY_SCANS", FLS, count_when(equals("DIM_DATE", "snow_condition", "Excellent"))),
        Metric("WEEKEND_WAIT_DELTA", FLS, lambda r: (
            F.avg(F.when(r("DIM_DATE", "is_weekend"), r(FLS, "wait_time_minutes")))
            - F.avg(F.when(~r("DIM_DATE", "is_weekend"), r(FLS, "wait_time_minutes"))))),
        Metric("EARLY_MORNING_SCANS", FLS, count_when(lambda r: r(FLS, "scan_hour") < 10)),
        Metric("PASS_HOLDER_SHARE_PCT", FLS, ratio(count_when(flag("DIM_CUSTOMER", "is_pass_holder")),
                                                   count_(FLS, "scan_key"), pct=True)),
        Metric("CAPACITY_UTILIZATION_PCT", FLS, ratio(count_(FLS, "scan_key"), sum_("DIM_LIFT", "capacity_per_hour"),
                                                      pct=True)),
        Metric("P95_WAIT_MINUTES_APPROX", FLS,
               lambda r: F.percentile_approx(r(FLS, "wait_time_minutes"), F.lit(0.95), F.lit(10000)),
               apart=True),
    ],
)

# -- sem_passholder_analytics (9 metrics, two facts) --------------------------------
_PASS = ilike("DIM_TICKET_TYPE", "ticket_category", "%Pass%")
PASSHOLDER = SemanticView(
    name="sem_passholder_analytics",
    comment="Pass holder utilisation and pass revenue",
    tables=[DIM_DATE, DIM_CUSTOMER, DIM_TICKET_TYPE, Table(FPU, "fact_pass_usage", "usage_key"),
            Table(FTS, "fact_ticket_sales", "sale_key")],
    relationships=[Relationship("PASS_USAGE_TO_DATE", FPU, "date_key", "DIM_DATE"),
                   Relationship("PASS_USAGE_TO_CUSTOMER", FPU, "customer_key", "DIM_CUSTOMER"),
                   Relationship("TICKET_SALES_TO_DATE", FTS, "purchase_date_key", "DIM_DATE"),
                   Relationship("TICKET_SALES_TO_CUSTOMER", FTS, "customer_key", "DIM_CUSTOMER"),
                   Relationship("TICKET_SALES_TO_TICKET_TYPE", FTS, "ticket_type_key", "DIM_TICKET_TYPE")],
    facts=[RowFact("TOTAL_LIFT_RIDES", FPU, "total_lift_rides"), RowFact("HOURS_ON_MOUNTAIN", FPU, "hours_on_mountain"),
           RowFact("PURCHASE_AMOUNT", FTS, "purchase_amount"), RowFact("IS_ADVANCE_PURCHASE", FTS, "is_advance_purchase"),
           RowFact("PURCHASE_CHANNEL", FTS, "purchase_channel")],
    dimensions=_date_dims(names=("FULL_DATE", "SKI_SEASON"))
    + _customer_dims(("PASS_TYPE", "CUSTOMER_SEGMENT", "STATE", "IS_PASS_HOLDER"))
    + [Dimension("TICKET_CATEGORY", "DIM_TICKET_TYPE", "ticket_category")],
    metrics=[
        Metric("PASS_HOLDER_VISITS", FPU,
               lambda r: F.count(F.when(r("DIM_CUSTOMER", "is_pass_holder"), r(FPU, "usage_key")))),
        Metric("ACTIVE_PASS_HOLDERS", FPU,
               lambda r: F.countDistinct(F.when(r("DIM_CUSTOMER", "is_pass_holder"), r(FPU, "customer_key")))),
        Metric("PASS_USAGE_PER_HOLDER", FPU, ratio(
            lambda r: F.count(F.when(r("DIM_CUSTOMER", "is_pass_holder"), r(FPU, "usage_key"))),
            lambda r: F.countDistinct(F.when(r("DIM_CUSTOMER", "is_pass_holder"), r(FPU, "customer_key"))))),
        Metric("PASS_HOURS_TOTAL", FPU, sum_when(flag("DIM_CUSTOMER", "is_pass_holder"), FPU, "hours_on_mountain")),
        Metric("AVERAGE_PASS_SESSION_HOURS", FPU, ratio(
            sum_when(flag("DIM_CUSTOMER", "is_pass_holder"), FPU, "hours_on_mountain"),
            lambda r: F.count(F.when(r("DIM_CUSTOMER", "is_pass_holder"), r(FPU, "usage_key"))))),
        Metric("PASS_LIFT_RIDES_TOTAL", FPU, sum_when(flag("DIM_CUSTOMER", "is_pass_holder"), FPU, "total_lift_rides")),
        Metric("PASS_REVENUE_TOTAL", FTS, sum_when(_PASS, FTS, "purchase_amount")),
        Metric("AVERAGE_PASS_PRICE", FTS, ratio(
            sum_when(_PASS, FTS, "purchase_amount"),
            lambda r: F.count(F.when(_PASS(r), r(FTS, "sale_key"))))),
        Metric("ADVANCE_PASS_SHARE_PCT", FTS, ratio(
            count_when(lambda r: _PASS(r) & r(FTS, "is_advance_purchase")),
            lambda r: F.count(F.when(_PASS(r), r(FTS, "sale_key"))), pct=True)),
    ],
)

# -- sem_revenue (12 metrics, three facts) ------------------------------------------
_ONLINE = equals(FTS, "purchase_channel", "online")
REVENUE = SemanticView(
    name="sem_revenue",
    comment="Revenue semantic view for ticket, rental, and F&B performance across channels",
    tables=[DIM_DATE, DIM_CUSTOMER, DIM_LOCATION, DIM_TICKET_TYPE, DIM_PRODUCT,
            Table(FTS, "fact_ticket_sales", "sale_key", ("ticket_sales", "pass_sales")),
            Table(FR, "fact_rentals", "rental_key", ("rental_transactions",)),
            Table(FFB, "fact_food_beverage", "transaction_key", ("fnb_sales",))],
    relationships=[
        Relationship("TICKET_SALES_TO_DATE", FTS, "purchase_date_key", "DIM_DATE"),
        Relationship("TICKET_SALES_TO_CUSTOMER", FTS, "customer_key", "DIM_CUSTOMER"),
        Relationship("TICKET_SALES_TO_LOCATION", FTS, "location_key", "DIM_LOCATION"),
        Relationship("TICKET_SALES_TO_TICKET_TYPE", FTS, "ticket_type_key", "DIM_TICKET_TYPE"),
        Relationship("RENTALS_TO_DATE", FR, "rental_date_key", "DIM_DATE"),
        Relationship("RENTALS_TO_CUSTOMER", FR, "customer_key", "DIM_CUSTOMER"),
        Relationship("RENTALS_TO_LOCATION", FR, "location_key", "DIM_LOCATION"),
        Relationship("RENTALS_TO_PRODUCT", FR, "product_key", "DIM_PRODUCT"),
        Relationship("FNB_TO_DATE", FFB, "transaction_date_key", "DIM_DATE"),
        Relationship("FNB_TO_CUSTOMER", FFB, "customer_key", "DIM_CUSTOMER"),
        Relationship("FNB_TO_LOCATION", FFB, "location_key", "DIM_LOCATION"),
        Relationship("FNB_TO_PRODUCT", FFB, "product_key", "DIM_PRODUCT"),
    ],
    facts=[RowFact("PURCHASE_AMOUNT", FTS, "purchase_amount"), RowFact("IS_ADVANCE_PURCHASE", FTS, "is_advance_purchase"),
           RowFact("PURCHASE_CHANNEL", FTS, "purchase_channel"), RowFact("RENTAL_AMOUNT", FR, "rental_amount"),
           RowFact("RENTAL_MARKUP", FR, "rental_markup"), RowFact("TOTAL_AMOUNT", FFB, "total_amount"),
           RowFact("UPSELL_AMOUNT", FFB, "upsell_amount")],
    dimensions=[Dimension("FULL_DATE", "DIM_DATE", "full_date", ("transaction_date",)),
                Dimension("SKI_SEASON", "DIM_DATE", "ski_season", ("season",)),
                Dimension("MONTH_NAME", "DIM_DATE", "month_name")]
    + _customer_dims(("CUSTOMER_SEGMENT", "IS_PASS_HOLDER"))
    + [Dimension("LOCATION_NAME", "DIM_LOCATION", "location_name"),
       Dimension("LOCATION_TYPE", "DIM_LOCATION", "location_type"),
       Dimension("TICKET_CATEGORY", "DIM_TICKET_TYPE", "ticket_category"),
       Dimension("PRODUCT_CATEGORY", "DIM_PRODUCT", "product_category"),
       Dimension("PRODUCT_TYPE", "DIM_PRODUCT", "product_type")],
    metrics=[
        Metric("TICKET_REVENUE", FTS, sum_(FTS, "purchase_amount")),
        Metric("TICKETS_SOLD", FTS, count_(FTS, "sale_key")),
        Metric("ADVANCE_SALES_SHARE_PCT", FTS, ratio(count_when(flag(FTS, "is_advance_purchase")),
                                                     count_(FTS, "sale_key"), pct=True)),
        Metric("ONLINE_CHANNEL_REVENUE", FTS, sum_when(_ONLINE, FTS, "purchase_amount")),
        Metric("ONLINE_CHANNEL_SHARE_PCT", FTS, ratio(sum_when(_ONLINE, FTS, "purchase_amount"),
                                                      sum_(FTS, "purchase_amount"), pct=True)),
        Metric("AVERAGE_TICKET_PRICE", FTS, ratio(sum_(FTS, "purchase_amount"), count_(FTS, "sale_key"))),
        Metric("RENTAL_REVENUE", FR, sum_(FR, "rental_amount")),
        Metric("RENTAL_TRANSACTIONS", FR, count_(FR, "rental_key")),
        Metric("RENTAL_MARKUP_DOLLARS", FR, sum_(FR, "rental_markup")),
        Metric("FNB_REVENUE", FFB, sum_(FFB, "total_amount")),
        Metric("FNB_TRANSACTIONS", FFB, count_(FFB, "transaction_key")),
        Metric("FNB_UPSELL_REVENUE", FFB, sum_(FFB, "upsell_amount")),
    ],
    derived=[DerivedMetric("TOTAL_REVENUE", ("TICKET_REVENUE", "RENTAL_REVENUE", "FNB_REVENUE"),
                           lambda m: F.coalesce(m["TICKET_REVENUE"], F.lit(0.0))
                           + F.coalesce(m["RENTAL_REVENUE"], F.lit(0.0))
                           + F.coalesce(m["FNB_REVENUE"], F.lit(0.0)),
                           "Ticket + rental + F&B revenue, combined only on request")],
)

# -- single-table views -------------------------------------------------------------
FF = "FACT_FEEDBACK"
CUSTOMER_SATISFACTION = SemanticView(
    name="sem_customer_satisfaction",
    comment="Guest feedback and satisfaction",
    tables=[Table(FF, "fact_feedback", "feedback_id")],
    relationships=[],
    facts=[RowFact(n, FF, c) for n, c in (("RATING", "rating"), ("SENTIMENT_SCORE", "sentiment_score"),
                                          ("NPS_SCORE", "nps_score"), ("LIKELIHOOD_TO_RETURN", "likelihood_to_return"),
                                          ("LIKELIHOOD_TO_RECOMMEND", "likelihood_to_recommend"),
                                          ("RESPONSE_TIME_DAYS", "response_time_days"))],
    dimensions=[Dimension(n, FF, n.lower()) for n in ("FEEDBACK_DATE", "CATEGORY", "SENTIMENT", "FEEDBACK_TYPE",
                                                     "RESOLVED", "CUSTOMER_SEGMENT")],
    metrics=[
        Metric("TOTAL_FEEDBACK", FF, count_(FF, "feedback_id")),
        Metric("AVERAGE_RATING", FF, avg_(FF, "rating")),
        Metric("AVERAGE_NPS", FF, avg_(FF, "nps_score")),
        Metric("POSITIVE_FEEDBACK_COUNT", FF, count_when(equals(FF, "sentiment", "Positive"))),
        Metric("NEGATIVE_FEEDBACK_COUNT", FF, count_when(equals(FF, "sentiment", "Negative"))),
    ],
)

FL = "FACT_LESSONS"
LESSONS = SemanticView(
    name="sem_lessons_analytics",
    comment="Ski school lessons",
    tables=[Table(FL, "fact_lessons", "lesson_id")],
    relationships=[],
    facts=[RowFact(n, FL, n.lower()) for n in ("LESSON_AMOUNT", "TOTAL_LESSON_REVENUE", "DURATION_HOURS",
                                               "GROUP_SIZE", "STUDENT_RATING")],
    dimensions=[Dimension(n, FL, n.lower()) for n in ("LESSON_DATE", "LESSON_TYPE", "SPORT_TYPE", "SKILL_LEVEL",
                                                     "INSTRUCTOR_NAME", "BOOKING_CHANNEL", "COMPLETED",
                                                     "CUSTOMER_SEGMENT")],
    metrics=[
        Metric("TOTAL_LESSONS", FL, count_(FL, "lesson_id")),
        Metric("TOTAL_REVENUE", FL, sum_(FL, "total_lesson_revenue")),
        Metric("AVG_STUDENT_RATING", FL, avg_(FL, "student_rating")),
        Metric("PRIVATE_LESSONS", FL, count_when(equals(FL, "lesson_type", "Private"))),
        Metric("GROUP_LESSONS", FL, count_when(equals(FL, "lesson_type", "Group"))),
    ],
)

FI = "FACT_INCIDENTS"
SAFETY = SemanticView(
    name="sem_safety_incidents",
    comment="Safety incidents and patrol response",
    tables=[Table(FI, "fact_incidents", "incident_id")],
    relationships=[],
    facts=[RowFact("SEVERITY_SCORE", FI, "severity_score"),
           RowFact("PATROL_RESPONSE_MINUTES", FI, "patrol_response_minutes")],
    dimensions=[Dimension(n, FI, n.lower()) for n in ("INCIDENT_DATE", "INCIDENT_TYPE", "SEVERITY", "LOCATION_ID",
                                                     "LIFT_ID", "TRAIL_NAME", "CUSTOMER_SKILL_LEVEL",
                                                     "TRANSPORT_REQUIRED", "CUSTOMER_SEGMENT")],
    metrics=[
        Metric("TOTAL_INCIDENTS", FI, count_(FI, "incident_id")),
        Metric("AVERAGE_SEVERITY", FI, avg_(FI, "severity_score")),
        Metric("CRITICAL_INCIDENTS", FI, count_when(equals(FI, "severity", "Critical"))),
        Metric("AVG_PATROL_RESPONSE", FI, avg_(FI, "patrol_response_minutes")),
    ],
)

# -- views whose dimension tables carry other aliases -----------------------------------
DATES = Table("DATES", "dim_date", "date_key")
MK = "MARKETING"
MARKETING = SemanticView(
    name="sem_marketing_analytics",
    comment="Campaign reach, conversion and attributed revenue",
    tables=[DATES, Table(MK, "fact_marketing", "marketing_key")],
    relationships=[Relationship("MARKETING_TO_DATE", MK, "send_date_key", "DATES")],
    facts=[RowFact(n, MK, n.lower()) for n in ("TARGET_COUNT", "CONVERSION_COUNT", "REVENUE_ATTRIBUTED", "OPEN_RATE",
                                               "CLICK_RATE", "CONVERSION_RATE")],
    dimensions=[Dimension("SENT_DATE", MK, "sent_date"), Dimension("MONTH_NAME", "DATES", "month_name"),
                Dimension("SKI_SEASON", "DATES", "ski_season", ("season",))]
    + [Dimension(n, MK, n.lower()) for n in ("CAMPAIGN_NAME", "CAMPAIGN_CHANNEL", "CAMPAIGN_TYPE", "AUDIENCE_SEGMENT")],
    metrics=[
        Metric("TOTAL_TARGETED", MK, sum_(MK, "target_count")),
        Metric("TOTAL_CONVERSIONS", MK, sum_(MK, "conversion_count")),
        Metric("TOTAL_REVENUE", MK, sum_(MK, "revenue_attributed")),
        Metric("AVG_OPEN_RATE", MK, avg_(MK, "open_rate")),
        Metric("AVG_CLICK_RATE", MK, avg_(MK, "click_rate")),
        Metric("AVG_CONVERSION_RATE", MK, avg_(MK, "conversion_rate")),
        Metric("REVENUE_PER_CONVERSION", MK, ratio(sum_(MK, "revenue_attributed"), sum_(MK, "conversion_count"))),
        Metric("CAMPAIGN_COUNT", MK, count_(MK, "marketing_key")),
    ],
)

SF = "STAFFING"
STAFFING = SemanticView(
    name="sem_staffing_analytics",
    comment="Scheduled versus actual staffing",
    tables=[DATES, Table("LOCATIONS", "dim_location", "location_key"), Table(SF, "fact_staffing", "staffing_key")],
    relationships=[Relationship("STAFFING_TO_DATE", SF, "date_key", "DATES"),
                   Relationship("STAFFING_TO_LOCATION", SF, "location_key", "LOCATIONS")],
    facts=[RowFact(n, SF, n.lower()) for n in ("SCHEDULED_EMPLOYEES", "ACTUAL_EMPLOYEES", "COVERAGE_RATIO",
                                               "SHIFT_HOURS", "SCHEDULED_LABOR_HOURS", "ACTUAL_LABOR_HOURS")],
    dimensions=[Dimension(n, "DATES", n.lower()) for n in ("FULL_DATE", "DAY_NAME", "SKI_SEASON", "IS_WEEKEND",
                                                          "IS_HOLIDAY")]
    + [Dimension("DEPARTMENT", SF, "department"), Dimension("JOB_ROLE", SF, "job_role"),
       Dimension("LOCATION_NAME", "LOCATIONS", "location_name")],
    metrics=[
        Metric("TOTAL_SCHEDULED", SF, sum_(SF, "scheduled_employees")),
        Metric("TOTAL_ACTUAL", SF, sum_(SF, "actual_employees")),
        Metric("AVG_COVERAGE", SF, avg_(SF, "coverage_ratio")),
        Metric("UNDERSTAFFED_COUNT", SF, count_when(flag(SF, "is_understaffed"))),
        Metric("TOTAL_SCHEDULED_HOURS", SF, sum_(SF, "scheduled_labor_hours")),
        Metric("TOTAL_ACTUAL_HOURS", SF, sum_(SF, "actual_labor_hours")),
        Metric("SHIFT_COUNT", SF, count_(SF, "staffing_key")),
    ],
)

WX = "WEATHER"
WEATHER = SemanticView(
    name="sem_weather_analytics",
    comment="Mountain weather by zone",
    tables=[DATES, Table(WX, "fact_weather", "weather_key")],
    relationships=[Relationship("WEATHER_TO_DATE", WX, "date_key", "DATES")],
    facts=[RowFact(n, WX, n.lower()) for n in ("SNOWFALL_INCHES", "BASE_DEPTH_INCHES", "TEMP_HIGH_F", "TEMP_LOW_F",
                                               "WIND_SPEED_MPH")],
    dimensions=[Dimension(n, "DATES", n.lower()) for n in ("FULL_DATE", "DAY_NAME", "SKI_SEASON", "MONTH_NAME",
                                                          "IS_WEEKEND", "IS_HOLIDAY")]
    + [Dimension("MOUNTAIN_ZONE", WX, "mountain_zone"), Dimension("SNOW_CONDITION", WX, "snow_condition")],
    metrics=[
        Metric("TOTAL_SNOWFALL", WX, sum_(WX, "snowfall_inches")),
        Metric("MAX_SNOWFALL", WX, max_(WX, "snowfall_inches")),
        Metric("MAX_BASE_DEPTH", WX, max_(WX, "base_depth_inches")),
        Metric("MIN_TEMP", WX, min_(WX, "temp_low_f")),
        Metric("MAX_TEMP", WX, max_(WX, "temp_high_f")),
        Metric("MAX_WIND", WX, max_(WX, "wind_speed_mph")),
        Metric("AVG_SNOWFALL", WX, avg_(WX, "snowfall_inches")),
        Metric("POWDER_DAY_COUNT", WX, count_when(flag(WX, "is_powder_day"))),
        Metric("HIGH_WIND_COUNT", WX, count_when(flag(WX, "is_high_wind"))),
        Metric("STORM_COUNT", WX, count_when(flag(WX, "storm_warning"))),
        Metric("OBSERVATION_COUNT", WX, count_(WX, "weather_key")),
    ],
)

VIEWS = {v.name: v for v in (CUSTOMER_BEHAVIOR, CUSTOMER_SATISFACTION, DAILY_SUMMARY, LESSONS, MARKETING, OPERATIONS,
                              PASSHOLDER, REVENUE, SAFETY, STAFFING, WEATHER)}
