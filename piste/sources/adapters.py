"""Bind the driver's TPC-H-like tables to the resort raw schema.

Every adapter is a pure projection (plus, where the resort grain needs it, one join or
one aggregation) so Catalyst prunes columns and pushes filters straight through to the
parquet scan.  The oracle SQL repeats these definitions as CTEs.

Derived attributes use fixed arithmetic rules on the source keys so that every value
is deterministic and identical in the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piste.functions.core import fround
from piste.sources.driver import DriverTables

# Raw-table defaults used by the adapters.
LOAD_TS = "2020-11-01 00:00:00"        # created_at / valid_from of master data
AS_OF_DATE = "2025-01-01"              # the "current date" every age is measured at
N_LOCATIONS = 25                       # locations are the nations


def _ts(s: str) -> Column:
    return F.lit(s).cast("timestamp_ntz")


def _hours(c: Column) -> Column:
    return F.make_dt_interval(F.lit(0), c.cast("int"))


def money(c: Column) -> Column:
    """Money is exact decimal (NUMBER(p,2) in the warehouse): sums are order-independent."""
    return c.cast("decimal(18,2)")


#: The columns of a line that its keys and dates come from.
LINE_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag")
#: The further columns that facts of sales take from a line.
LINE_AMOUNTS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _met(lo: DataFrame) -> list[str]:
    """Dimension versions that the rows met before (operators/facts.py); they go along."""
    return [c for c in lo.columns if c.startswith("__")]


def _if(lo: DataFrame, source: str, *cols: Column) -> tuple[Column, ...]:
    """Columns made from ``source``, none of them for lines that come without it."""
    return cols if source in lo.columns else ()


def _line_id(prefix: str = "") -> Column:
    # (l_orderkey, l_linenumber) is not unique in the driver data; adding the part and
    # supplier keys makes it unique.
    return F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"))


def customers(t: DriverTables) -> DataFrame:
    nation = t.nation.select("n_nationkey", "n_name")
    c = t.customer
    k = F.col("c_custkey")
    return c.join(nation, c.c_nationkey == nation.n_nationkey, "left").select(
        k.alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.concat(F.lit("c"), k.cast("string"), F.lit("@example.com")).alias("email"),
        F.make_date(F.lit(1940) + k % 70, F.lit(1) + k % 12, F.lit(1) + k % 28).alias("birth_date"),
        F.col("c_mktsegment").alias("customer_segment"),
        (F.col("c_acctbal") > 5000).alias("is_pass_holder"),
        F.when(F.col("c_acctbal") > 8000, "Epic").when(F.col("c_acctbal") > 5000, "Local").alias("pass_type"),
        F.col("n_name").alias("state"),
        _ts(LOAD_TS).alias("created_at"),
    )


def lifts(t: DriverTables) -> DataFrame:
    nation = t.nation.select("n_nationkey", "n_regionkey")
    region = t.region.select("r_regionkey", "r_name")
    s = t.supplier
    k = F.col("s_suppkey")
    j = s.join(nation, s.s_nationkey == nation.n_nationkey, "left").join(
        region, F.col("n_regionkey") == region.r_regionkey, "left"
    )
    # Lift types cycled by key.
    lift_type = (
        F.when(k % 4 == 0, "Gondola").when(k % 4 == 1, "Express Quad")
        .when(k % 4 == 2, "Triple Chair").otherwise("Surface Lift")
    )
    return j.select(
        k.alias("lift_id"),
        F.col("s_name").alias("lift_name"),
        lift_type.alias("lift_type"),
        (F.lit(1000) + F.lit(100) * (k % 20)).cast("bigint").alias("capacity_per_hour"),
        (F.lit(500) + F.lit(100) * (k % 15)).cast("bigint").alias("vertical_feet"),
        F.col("r_name").alias("terrain_type"),
        F.when(F.col("s_acctbal") < 0, "Beginner").when(F.col("s_acctbal") < 5000, "Intermediate")
        .otherwise("Advanced").alias("difficulty_access"),
    )


def locations(t: DriverTables) -> DataFrame:
    region = t.region.select("r_regionkey", "r_name")
    n = t.nation
    return n.join(region, n.n_regionkey == region.r_regionkey, "left").select(
        F.col("n_nationkey").cast("bigint").alias("location_id"),
        F.col("n_name").alias("location_name"),
        F.col("r_name").alias("location_type"),
        F.col("r_name").alias("elevation_zone"),
    )


def products(t: DriverTables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("product_category"),
        F.col("p_type").alias("product_type"),
        money(F.col("p_retailprice")).alias("price"),
    )


def ticket_types(t: DriverTables) -> DataFrame:
    """One ticket type per order priority (distinct over one pruned column)."""
    p = F.substring(F.col("ticket_type_id"), 1, 1)
    # Category and list price per priority digit.
    category = (
        F.when(p == "1", "season_pass").when(p == "2", "multi_day").when(p == "3", "day_pass")
        .when(p == "4", "half_day").otherwise("day_pass")
    )
    price = money(
        F.when(p == "1", 899).when(p == "2", 349).when(p == "3", 129)
        .when(p == "4", 89).otherwise(109)
    )
    return (
        t.orders.select(F.col("o_orderpriority").alias("ticket_type_id")).distinct()
        .select(
            "ticket_type_id",
            F.col("ticket_type_id").alias("ticket_name"),
            category.alias("ticket_category"),
            F.when(p == "1", 150).when(p == "2", 3).otherwise(1).cast("bigint").alias("duration_days"),
            F.when(p == "1", "all_lifts").otherwise("standard").alias("access_level"),
            price.alias("price"),
        )
    )


def _channel(status: Column) -> Column:
    # Order status -> purchase channel.
    return F.when(status == "F", "online").when(status == "O", "window").when(status == "P", "kiosk")


def ticket_sales(t: DriverTables) -> DataFrame:
    return ticket_sales_from_orders(t.orders)


def ticket_sales_from_orders(o: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    purchase_date = F.to_date("o_orderdate")
    valid_from = F.date_add(purchase_date, (k % 5).cast("int"))
    return o.select(
        k.alias("sale_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderpriority").alias("ticket_type_id"),
        (k % N_LOCATIONS).alias("location_id"),
        F.col("o_orderdate").alias("purchase_timestamp"),
        valid_from.alias("valid_from_date"),
        F.date_add(valid_from, 1).alias("valid_to_date"),
        money(F.col("o_totalprice")).alias("purchase_amount"),
        F.lit("card").alias("payment_method"),
        _channel(F.col("o_orderstatus")).alias("purchase_channel"),
        F.col("o_orderdate").alias("created_at"),
        *_met(o),
    )


def pass_usage(t: DriverTables) -> DataFrame:
    """One visit per (customer, order date): the grain of the resort's pass_usage."""
    d = F.to_date("o_orderdate")
    g = t.orders.groupBy(F.col("o_custkey").alias("customer_id"), d.alias("visit_date")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("o_orderdate").alias("first_ts"),
    )
    return g.select(
        F.concat_ws("-", F.col("customer_id"), F.date_format("visit_date", "yyyyMMdd")).alias("usage_id"),
        "customer_id",
        "visit_date",
        (F.col("first_ts") + F.make_dt_interval(F.lit(0), F.lit(8))).alias("first_scan_time"),
        (F.col("first_ts") + F.make_dt_interval(F.lit(0), F.lit(15))).alias("last_scan_time"),
        (F.col("n") * 6 + (F.col("customer_id") % 7)).cast("bigint").alias("total_lift_rides"),
        # quarter hours: exact in binary floating point, so sums do not depend on order
        ((F.col("n") * 6 + F.col("customer_id") % 5) / 4.0).alias("hours_on_mountain"),
        F.col("first_ts").alias("created_at"),
    )


def line_orders(t: DriverTables) -> DataFrame:
    """lineitem enriched with the ordering customer: the one big-big join of the model."""
    o = t.orders.select("o_orderkey", "o_custkey")
    return t.lineitem.join(o, t.lineitem.l_orderkey == o.o_orderkey, "inner")


def lift_scans(t: DriverTables) -> DataFrame:
    return lift_scans_from_lines(line_orders(t))


def lift_scans_from_lines(lo: DataFrame) -> DataFrame:
    """lineitem rows (joined with their order's customer) -> raw lift scans."""
    hour = F.lit(8) + (F.col("l_partkey") + F.col("l_linenumber")) % 9
    return lo.select(
        _line_id().alias("scan_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("l_suppkey").alias("lift_id"),
        (F.col("l_shipdate") + _hours(hour)).alias("scan_timestamp"),
        *_if(lo, "l_quantity", (F.col("l_quantity") / 2.0).alias("wait_time_minutes")),
        *_if(lo, "l_tax", (F.lit(10) + F.floor(F.col("l_tax") * 300)).cast("bigint").alias("temperature_f")),
        *_if(lo, "l_linestatus", F.when(F.col("l_linestatus") == "F", "Clear").otherwise("Snow").alias("weather_condition")),
        F.col("l_shipdate").alias("created_at"),
        *_met(lo),
    )


def food_beverage(t: DriverTables) -> DataFrame:
    return food_beverage_from_lines(line_orders(t))


def food_beverage_time() -> Column:
    return F.col("l_shipdate") + _hours(F.lit(11) + F.col("l_linenumber") % 6)


def food_beverage_from_lines(lo: DataFrame) -> DataFrame:
    return lo.select(
        _line_id().alias("transaction_id"),
        F.col("o_custkey").alias("customer_id"),
        (F.col("l_suppkey") % N_LOCATIONS).alias("location_id"),
        F.col("l_partkey").alias("product_id"),
        food_beverage_time().alias("transaction_timestamp"),
        *_if(lo, "l_quantity",
             F.col("l_quantity").cast("bigint").alias("quantity"),
             F.round(money(F.col("l_extendedprice")) / F.col("l_quantity").cast("decimal(18,0)"), 2)
             .cast("decimal(18,2)").alias("unit_price"),
             F.round(money(F.col("l_extendedprice")) * (1 - F.col("l_discount").cast("decimal(4,2)")), 2)
             .cast("decimal(18,2)").alias("total_amount")),
        F.lit("card").alias("payment_method"),
        F.col("l_shipdate").alias("created_at"),
        *_met(lo),
    )


def rentals(t: DriverTables) -> DataFrame:
    return rentals_from_lines(line_orders(t))


def rental_time() -> Column:
    return F.col("l_shipdate") + _hours(F.lit(9))


def rentals_from_lines(lo: DataFrame) -> DataFrame:
    return lo.filter(F.col("l_returnflag") == "R").select(
        _line_id().alias("rental_id"),
        F.col("o_custkey").alias("customer_id"),
        (F.col("l_suppkey") % N_LOCATIONS).alias("location_id"),
        F.col("l_partkey").alias("product_id"),
        rental_time().alias("rental_timestamp"),
        (F.col("l_shipdate") + F.make_dt_interval(F.lit(1), F.lit(16))).alias("return_timestamp"),
        F.lit(31.0).alias("rental_duration_hours"),
        *_if(lo, "l_tax", F.round(money(F.col("l_extendedprice")) * (1 + F.col("l_tax").cast("decimal(4,2)")) * F.lit(0.01)
                                  .cast("decimal(4,2)"), 2).cast("decimal(18,2)").alias("rental_amount")),
        F.col("l_shipdate").alias("created_at"),
        *_met(lo),
    )


# -- operations tables derived from the driver data ------------------------------------
# Mountain zones, departments, incident types, lesson types.
ZONES = ["Summit Peak", "North Ridge", "Alpine Bowl", "Village Base"]
DEPARTMENTS = ["Lift Operations", "Ticketing", "Rental Services", "Food & Beverage", "Guest Services"]
INCIDENT_TYPES = ["collision", "fall", "equipment_failure", "medical", "lost_skier", "lift_issue"]
LESSON_TYPES = ["Private", "Semi_Private", "Group", "Kids_Camp", "Race_Clinic", "Freestyle_Camp"]


def _pick(idx: Column, values: list[str]) -> Column:
    """values[idx] for a non-negative integer column (CASE chain, stays in codegen)."""
    expr = None
    for i, v in enumerate(values):
        expr = F.when(idx == i, v) if expr is None else expr.when(idx == i, v)
    return expr


def weather_conditions(t: DriverTables) -> DataFrame:
    """One observation per (ship date, zone): lineitem discounts/taxes as snow/temperature.

    Values come from integer sums so that every engine derives identical numbers.
    """
    li = t.lineitem
    zone = (F.col("l_suppkey") % 4).cast("int")
    g = li.groupBy(F.to_date("l_shipdate").alias("weather_date"), zone.alias("zone")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("disc"),
        F.sum(F.round(F.col("l_tax") * 100).cast("bigint")).alias("tax"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("qty"),
        F.max(F.round(F.col("l_discount") * 100).cast("bigint")).alias("max_disc"),
    )
    snow = F.expr("(disc * 120) div n") / 100.0
    high = F.lit(15.0) + F.expr("(tax * 40) div n") / 10.0
    return g.select(
        "weather_date",
        _pick(F.col("zone"), ZONES).alias("mountain_zone"),
        F.when(snow >= 6, "Powder").when(snow >= 3, "Packed Powder").when(snow >= 1, "Groomed").otherwise("Icy")
        .alias("snow_condition"),
        snow.alias("snowfall_inches"),
        (F.expr("(qty * 3) div n")).cast("double").alias("base_depth_inches"),
        high.alias("temp_high_f"),
        (high - 12).alias("temp_low_f"),
        (F.col("max_disc") * 28 / 10.0).alias("wind_speed_mph"),
        (F.col("max_disc") >= 10).alias("storm_warning"),
        F.col("weather_date").cast("timestamp_ntz").alias("created_at"),
    )


def staffing_schedule(t: DriverTables) -> DataFrame:
    """One shift per (order date, priority): staff scheduled vs present."""
    o = t.orders
    d = F.to_date("o_orderdate")
    g = o.groupBy(d.alias("schedule_date"), F.col("o_orderpriority").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    digit = F.substring("p", 1, 1).cast("int")
    sched = F.col("n") + 2
    actual = sched - F.when(F.col("n") % 3 == 0, 1).otherwise(0)
    start = F.col("schedule_date").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(8), F.when(F.col("n") % 2 == 1, 50).otherwise(0))
    return g.select(
        F.concat_ws("-", F.date_format("schedule_date", "yyyyMMdd"), F.col("p")).alias("schedule_id"),
        digit.cast("bigint").alias("location_id"),
        "schedule_date",
        start.alias("shift_start"),
        (F.col("schedule_date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(17), F.lit(10)))
        .alias("shift_end"),
        _pick(digit - 1, DEPARTMENTS).alias("department"),
        F.lit("Staff").alias("job_role"),
        sched.cast("int").alias("scheduled_employees"),
        actual.cast("int").alias("actual_employees"),
        fround(actual / sched, 2).alias("coverage_ratio"),
        F.col("schedule_date").cast("timestamp_ntz").alias("created_at"),
    )


def customer_feedback(t: DriverTables) -> DataFrame:
    """Every event is a survey response of its user."""
    e = t.events
    k = F.col("event_id")
    nps = (F.floor(F.col("value")) % 11).cast("int")
    fdate = F.to_date("ts")
    return e.select(
        k.alias("feedback_id"),
        F.col("user_id").alias("customer_id"),
        fdate.alias("feedback_date"),
        F.col("event_type").alias("feedback_type"),
        _pick((k % 4).cast("int"), ["Lifts", "Food", "Rentals", "Lessons"]).alias("category"),
        nps.alias("nps_score"),
        ((k % 5) + 1).cast("double").alias("satisfaction_score"),
        ((k % 10) + 1).cast("int").alias("likelihood_to_return"),
        ((k % 7) + 4).cast("int").alias("likelihood_to_recommend"),
        ((nps - 5) / 5.0).alias("sentiment_score"),
        F.when(nps >= 9, "Positive").when(nps >= 7, "Neutral").otherwise("Negative").alias("sentiment"),
        F.when(k % 4 != 0, F.date_add(fdate, (k % 4).cast("int"))).alias("response_date"),
        (k % 3 == 0).alias("resolved"),
        F.col("ts").alias("created_at"),
    )


def incidents(t: DriverTables) -> DataFrame:
    """Error events are incidents; the event value drives severity and response time."""
    e = t.events.filter(F.col("event_type") == "error")
    k, v = F.col("event_id"), F.col("value")
    return e.select(
        k.alias("incident_id"),
        F.to_date("ts").alias("incident_date"),
        F.date_format("ts", "HH:mm:ss").alias("incident_time"),
        F.col("ts").alias("incident_timestamp"),
        _pick((k % 6).cast("int"), INCIDENT_TYPES).alias("incident_type"),
        F.when(v < 3, "Minor").when(v < 6, "Moderate").when(v < 20, "Serious").otherwise("Critical").alias("severity"),
        (F.col("user_id") % 25).alias("location_id"),
        (k % 100).alias("lift_id"),
        F.concat(F.lit("Trail "), (k % 12).cast("string")).alias("trail_name"),
        F.col("user_id").alias("customer_id"),
        _pick((k % 3).cast("int"), ["beginner", "intermediate", "expert"]).alias("customer_skill_level"),
        (v > 8).alias("transport_required"),
        (F.floor(v * 10) / 10.0).alias("patrol_response_minutes"),
        F.col("ts").alias("created_at"),
    )


def instructors(t: DriverTables) -> DataFrame:
    s = t.supplier
    return s.select(
        F.col("s_suppkey").alias("instructor_id"),
        F.col("s_name").alias("instructor_name"),
        F.when(F.col("s_acctbal") > 5000, "Level 3").otherwise("Level 2").alias("certification_level"),
        ((F.col("s_suppkey") % 20) / 10.0 + 3.0).alias("avg_rating"),
    )


def ski_lessons(t: DriverTables) -> DataFrame:
    """Purchase events are lesson bookings."""
    e = t.events.filter(F.col("event_type") == "purchase")
    k = F.col("event_id")
    return e.select(
        k.alias("lesson_id"),
        F.col("user_id").alias("customer_id"),
        F.to_date("ts").alias("lesson_date"),
        F.date_format("ts", "HH:mm:ss").alias("lesson_start_time"),
        _pick((k % 6).cast("int"), LESSON_TYPES).alias("lesson_type"),
        F.when(F.col("user_id") % 2 == 0, "Ski").otherwise("Snowboard").alias("sport_type"),
        _pick((k % 3).cast("int"), ["beginner", "intermediate", "advanced"]).alias("skill_level"),
        ((k % 3) + 1).cast("double").alias("duration_hours"),
        (k % 40).alias("instructor_id"),
        ((k % 6) + 1).cast("int").alias("group_size"),
        money(F.col("value")).alias("lesson_amount"),
        money(F.when(k % 2 == 0, 25)).alias("rental_amount"),
        money(F.when(k % 3 == 0, 10)).alias("tip_amount"),
        _pick((k % 3).cast("int"), ["online", "phone", "walk_in"]).alias("booking_channel"),
        (k % 10 != 0).alias("completed"),
        ((k % 5) + 1).cast("double").alias("student_rating"),
        F.col("ts").alias("created_at"),
    )


# -- marketing and season-pass tables derived from the driver data -----------------------
EVENT_CHANNEL = {"click": "email", "view": "social", "purchase": "email", "signup": "web", "error": "sms"}


def _event_channel(c: Column) -> Column:
    expr = None
    for k, v in EVENT_CHANNEL.items():
        expr = F.when(c == k, v) if expr is None else expr.when(c == k, v)
    return expr


def marketing_touches(t: DriverTables) -> DataFrame:
    """One campaign send per (event day, event type); engagement from event values."""
    e = t.events
    g = e.groupBy(F.to_date("ts").alias("send_date"), F.col("event_type")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("value") > 100, 1)).alias("conv"),
        F.count(F.when(F.col("value") > 5, 1)).alias("opened"),
        F.count(F.when(F.col("value") > 20, 1)).alias("clicked"),
        F.sum(money(F.col("value"))).alias("revenue"))
    return g.select(
        F.concat_ws("-", F.date_format("send_date", "yyyyMMdd"), F.col("event_type")).alias("touch_id"),
        F.col("event_type").alias("campaign_id"),
        F.concat(F.initcap("event_type"), F.lit(" Campaign")).alias("campaign_name"),
        _event_channel(F.col("event_type")).alias("campaign_channel"),
        F.when(F.col("event_type").isin("purchase", "signup"), "Acquisition").otherwise("Engagement")
        .alias("campaign_type"),
        F.when(F.dayofweek("send_date").isin(1, 7), "weekend_warrior").otherwise("local_pass_holder")
        .alias("audience_segment"),
        "send_date",
        (F.col("n") * 10).cast("bigint").alias("target_count"),
        F.col("conv").cast("bigint").alias("conversion_count"),
        fround(F.col("opened") / F.col("n"), 4).alias("open_rate"),
        fround(F.col("clicked") / F.col("n"), 4).alias("click_rate"),
        F.col("revenue").cast("decimal(18,2)").alias("revenue_attributed"),
        F.col("send_date").cast("timestamp_ntz").alias("created_at"),
    )


def marketing_campaigns(t: DriverTables) -> DataFrame:
    """One campaign per event type: spend from reach, revenue from converted events."""
    e = t.events
    g = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("start"), F.max("ts").alias("end"),
                                    F.sum(F.when(F.col("value") > 100, money(F.col("value")))).alias("rev"))
    return g.select(
        F.col("event_type").alias("campaign_id"),
        F.concat(F.initcap("event_type"), F.lit(" Campaign")).alias("campaign_name"),
        F.when(F.col("event_type").isin("purchase", "signup"), "Acquisition").otherwise("Engagement")
        .alias("campaign_type"),
        _event_channel(F.col("event_type")).alias("channel"),
        F.to_date("start").alias("start_date"), F.to_date("end").alias("end_date"),
        (F.col("n") * F.lit(2.5).cast("decimal(4,2)")).cast("decimal(18,2)").alias("actual_spend"),
        F.coalesce(F.col("rev"), money(F.lit(0))).cast("decimal(18,2)").alias("revenue_attributed"),
    )


def campaign_touches(t: DriverTables) -> DataFrame:
    """Every event is a touch of its user by the campaign of its type."""
    e = t.events
    v = F.col("value")
    return e.select(
        F.col("event_id").alias("touch_id"), F.col("user_id").alias("customer_id"),
        F.col("event_type").alias("campaign_id"), _event_channel(F.col("event_type")).alias("channel"),
        F.col("ts").alias("touch_timestamp"), F.lit(True).alias("was_delivered"), (v > 5).alias("was_opened"),
        (v > 20).alias("was_clicked"), (v > 100).alias("converted"),
        F.when(v > 100, money(v)).alias("conversion_value"), F.col("ts").alias("created_at"),
    )


def pass_season(d: Column) -> Column:
    """Season a pass bought on ``d`` is valid for (passes sold from May are for the next season)."""
    y = F.year(d)
    start = F.when(F.month(d) >= 5, y).otherwise(y - 1)
    return F.concat(start.cast("string"), F.lit("-"), (start + 1).cast("string"))


def season_pass_sales(t: DriverTables) -> DataFrame:
    """Urgent-priority orders are season passes; a renewal is any purchase after the
    customer's first pass (first purchase per customer by aggregation, not a window, so
    a customer holding many rows never lands in one task)."""
    o = t.orders.filter(F.col("o_orderpriority") == "1-URGENT")
    d = F.to_date("o_orderdate")
    first = o.groupBy(F.col("o_custkey").alias("__c")).agg(F.min(d).alias("__first"))
    j = o.join(first, o.o_custkey == first.__c, "left")
    amt = money(F.col("o_totalprice"))
    orig = F.round(amt * F.lit(1.1).cast("decimal(3,1)"), 2).cast("decimal(18,2)")
    return j.select(
        F.col("o_orderkey").alias("sale_id"), F.col("o_custkey").alias("customer_id"),
        F.col("o_orderpriority").alias("ticket_type_id"), d.alias("purchase_date"),
        pass_season(d).alias("valid_season"), amt.alias("purchase_amount"), orig.alias("original_price"),
        (orig - amt).alias("discount_amount"), F.lit("card").alias("payment_method"),
        _channel(F.col("o_orderstatus")).alias("purchase_channel"), (d > F.col("__first")).alias("is_renewal"),
        _pick((F.col("o_orderkey") % 5).cast("int"), ["click", "view", "purchase", "signup", "error"])
        .alias("campaign_id"),
        F.col("o_orderdate").alias("created_at"),
    )


# -- parking, grooming, employees -----------------------------------------------------------
def parking_lots(t: DriverTables) -> DataFrame:
    """Every nation is a lot of its region's type."""
    n = t.nation
    k = F.col("n_nationkey")
    return n.join(t.region, n.n_regionkey == F.col("r_regionkey"), "left").select(
        k.cast("bigint").alias("lot_id"), F.concat(F.initcap("n_name"), F.lit(" Lot")).alias("lot_name"), F.col("r_name").alias("lot_type"),
        (k * 10 + 40).cast("int").alias("total_spaces"), money(k % 5 + 2).alias("hourly_rate"), money(k % 7 * 3 + 15).alias("daily_max"),
        (k * 120).cast("int").alias("distance_to_lifts_feet"), (k % 2 == 0).alias("has_shuttle"))


def parking_occupancy(t: DriverTables) -> DataFrame:
    """Events of a day and hour by user lot: each event stands for eight cars."""
    lot = (F.col("user_id") % 25).cast("bigint")
    g = t.events.groupBy(F.to_date("ts").alias("record_date"), F.hour("ts").alias("record_hour"), lot.alias("lot_id")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("value") > 5, 1)).alias("left"), F.sum(money(F.col("value"))).alias("revenue"))
    spaces = (F.col("lot_id") * 10 + 40).cast("int")
    occupied = F.least(spaces, (F.col("n") * 8).cast("int"))
    return g.select(
        F.concat_ws("-", F.date_format("record_date", "yyyyMMdd"), F.col("record_hour").cast("string"), F.col("lot_id").cast("string")).alias("record_id"),
        "lot_id", "record_date", "record_hour", F.concat(F.lit("Lot "), F.col("lot_id").cast("string")).alias("lot_name"), spaces.alias("total_spaces"),
        occupied.alias("occupied_spaces"), fround(occupied.cast("double") * 100 / spaces, 2).alias("occupancy_percent"), F.col("n").alias("vehicles_entered"),
        F.col("left").alias("vehicles_exited"), F.col("revenue").cast("decimal(18,2)").alias("revenue_collected"), (occupied >= spaces).alias("overflow_active"),
        F.col("record_date").cast("timestamp_ntz").alias("created_at"))


def grooming_logs(t: DriverTables) -> DataFrame:
    """Lines of a ship date by line number are a machine's run of that night."""
    g = t.lineitem.groupBy(F.to_date("l_shipdate").alias("grooming_date"), F.col("l_linenumber").alias("machine_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))
    before = _pick((F.col("quantity") % 4).cast("int"), ["poor", "fair", "icy", "good"])
    after = _pick((F.col("n") % 3).cast("int"), ["excellent", "good", "fair"])
    return g.select(
        F.concat_ws("-", F.date_format("grooming_date", "yyyyMMdd"), F.col("machine_id").cast("string")).alias("log_id"),
        (F.col("quantity") % 50).alias("groomer_id"), "machine_id", "grooming_date", _pick((F.col("machine_id") % 2).cast("int"), ["night", "early"]).alias("shift"),
        F.concat(F.lit("Trail "), (F.col("quantity") % 12).cast("string")).alias("trail_name"), (F.col("n") * 15).alias("duration_minutes"),
        F.col("quantity").cast("double").alias("snow_depth_inches"), before.alias("conditions_before"), after.alias("conditions_after"),
        F.col("grooming_date").cast("timestamp_ntz").alias("created_at"))


def employees(t: DriverTables) -> DataFrame:
    """Every supplier is an employee."""
    k = F.col("s_suppkey")
    return t.supplier.select(
        k.alias("employee_id"), F.col("s_name").alias("employee_name"), _pick((k % 5).cast("int"), DEPARTMENTS).alias("department"),
        _pick((k % 3).cast("int"), ["Attendant", "Operator", "Lead"]).alias("job_title"), F.when(k % 4 == 0, "seasonal").otherwise("full_time").alias("employment_type"),
        money(k % 15 + 18).alias("hourly_rate"), (k % 3 == 2).alias("is_supervisor"), F.when(k % 3 != 2, k - k % 3 + 2).alias("reports_to"))


# -- alert subscriptions ----------------------------------------------------------------------
def alert_subscriptions(t: DriverTables) -> DataFrame:
    """Every customer subscribes to one question; it was last sent when their latest event happened."""
    k = F.col("c_custkey")
    last = t.events.groupBy(F.col("user_id").alias("__user")).agg(F.max("ts").alias("last_sent_at"))
    c = t.customer.join(last, k == F.col("__user"), "left")
    return c.select(
        k.cast("string").alias("alert_id"), F.concat(F.lit("user"), (k % 50).cast("string"), F.lit("@example.org")).alias("recipient_email"),
        F.concat(F.lit("Revenue of "), F.lower("c_mktsegment"), F.lit(" customers")).alias("question"),
        _pick((k % 4).cast("int"), ["Daily", " weekly", "MONTHLY", "never"]).alias("frequency"), (k % 5 != 0).alias("is_active"), "last_sent_at")


def alert_results(t: DriverTables) -> DataFrame:
    """Every third event is an answer to its user's alert; error events carry an error."""
    e = t.events.filter(F.col("event_id") % 3 == 0)
    bad = F.col("event_type") == "error"
    return e.select(
        F.col("user_id").cast("string").alias("alert_id"), F.concat(F.lit("Event "), F.col("event_id").cast("string")).alias("question"),
        F.when(~bad, F.concat(F.lit("value "), F.floor("value").cast("string"))).alias("response"), F.when(bad, F.lit("no answer")).alias("error"))


# -- evaluation results -----------------------------------------------------------------------
def evaluation_results(t: DriverTables) -> DataFrame:
    """Every customer is a question: the statement that answers it and the one generated, which by
    customer number is the same, lacks a table, another aggregate or the grouping."""
    k = F.col("c_custkey")
    parts = {
        "expected": ("SUM(o_totalprice)", " JOIN mart.customer c ON o.o_custkey = c.c_custkey", " GROUP BY c.c_mktsegment"),
        "short": ("SUM(o_totalprice)", "", " GROUP BY c.c_mktsegment"),
        "other": ("AVG(o_totalprice)", " JOIN mart.customer c ON o.o_custkey = c.c_custkey", " GROUP BY c.c_mktsegment"),
        "flat": ("SUM(o_totalprice)", " JOIN mart.customer c ON o.o_custkey = c.c_custkey", ""),
    }
    sql = {name: F.concat(F.lit(f"SELECT {agg} FROM mart.orders o{join} WHERE o.o_comment <> 'GROUP BY ' AND segment = '"), F.col("c_mktsegment"), F.lit(f"'{group} -- "), F.col("c_name"))
           for name, (agg, join, group) in parts.items()}
    made = F.when(k % 4 == 1, sql["short"]).when(k % 4 == 2, sql["other"]).when(k % 4 == 3, sql["flat"]).otherwise(sql["expected"])
    return t.customer.select(
        k.alias("question_id"), F.col("c_mktsegment").alias("agent_name"), F.repeat(F.lit("x"), (k % 60 + 30).cast("int")).alias("answer"),
        F.when(k % 2 == 0, "Analyst").otherwise("search").alias("expected_tool"),
        F.when(k % 3 != 0, F.array(F.lit("data_analyst"))).otherwise(F.array().cast("array<string>")).alias("tools"),
        F.when(k % 7 != 0, made).alias("sql"), (k % 5 != 0).alias("sql_valid"), F.when(k % 11 != 0, sql["expected"]).alias("validation_query"))


def golden_questions(t: DriverTables) -> DataFrame:
    """Customers as golden questions: an agent per segment, two versions, three types."""
    k = F.col("c_custkey")
    return t.customer.select(k.alias("question_id"), F.col("c_mktsegment").alias("agent_name"), F.when(k % 2 == 0, "v1").otherwise("v2").alias("version"),
                             _pick((k % 3).cast("int"), ["simple", "join", "trend"]).alias("question_type"))
