"""Named business queries N01-N18 (the validated questions of the reference).

Each takes the star-schema mapping (``tables[name] -> DataFrame``) and returns a
DataFrame; top-k appears only where the question itself asks for a top-k.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piste.functions.core import fround, safe_div
from piste.plans import views as V
from piste.plans.semantic import _combine, query
from piste.plans.star import take

Tables = Mapping[str, DataFrame]


def _dim(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols)


def n01_avg_wait_by_lift_top5(t: Tables) -> DataFrame:
    """Average wait by lift, highest five (ties broken by lift name)."""
    f = take(t, "fact_lift_scans", "lift_key", "wait_time_minutes")
    lifts = _dim(t["dim_lift"], "lift_key", "lift_name")
    g = f.join(lifts, "lift_key").groupBy("lift_name").agg(
        fround(F.avg(F.col("wait_time_minutes").cast("double")), 2).alias("AVG_WAIT"))
    return g.orderBy(F.col("AVG_WAIT").desc(), F.col("lift_name")).limit(5).withColumnRenamed("lift_name", "LIFT_NAME")


def n02_coverage_by_department(t: Tables) -> DataFrame:
    """Departments by average coverage ratio, lowest first."""
    g = t["fact_staffing"].groupBy(F.col("department").alias("DEPARTMENT")).agg(
        fround(F.avg(F.col("coverage_ratio").cast("double")), 3).alias("AVG_COVERAGE"))
    return g.orderBy("AVG_COVERAGE", "DEPARTMENT")


def n03_powder_days(t: Tables) -> DataFrame:
    """Zone-days with at least 6 inches of new snow."""
    return t["fact_weather"].filter(F.col("snowfall_inches") >= 6).agg(F.count(F.lit(1)).alias("POWDER_DAYS"))


def _pass_with_customer(t: Tables, *cust_cols: str) -> DataFrame:
    f = take(t, "fact_pass_usage", "customer_key", "total_lift_rides")
    c = _dim(t["dim_customer"], "customer_key", *cust_cols)
    return f.join(c, "customer_key")


def n04_segment_visit_profile(t: Tables) -> DataFrame:
    j = _pass_with_customer(t, "customer_segment")
    return j.groupBy(F.col("customer_segment").alias("CUSTOMER_SEGMENT")).agg(
        F.countDistinct("customer_key").alias("CUSTOMERS"),
        F.count(F.lit(1)).alias("VISITS"),
        fround(F.avg(F.col("total_lift_rides").cast("double")), 1).alias("AVG_RIDES"),
    ).orderBy(F.col("VISITS").desc(), "CUSTOMER_SEGMENT")


def n05_visits_per_customer_by_segment(t: Tables) -> DataFrame:
    j = _pass_with_customer(t, "customer_segment")
    return j.groupBy(F.col("customer_segment").alias("CUSTOMER_SEGMENT")).agg(
        F.countDistinct("customer_key").alias("CUSTOMERS"),
        fround(safe_div(F.count(F.lit(1)), F.countDistinct("customer_key")), 1).alias("VISITS_PER_CUSTOMER"),
    ).orderBy(F.col("VISITS_PER_CUSTOMER").desc(), "CUSTOMER_SEGMENT")


def n06_revenue_by_category(t: Tables) -> DataFrame:
    """Revenue per business line: three aggregates stacked with unionByName."""
    def part(name, fact, col):
        return t[fact].agg(F.sum(col).cast("double").alias("REVENUE")).select(
            F.lit(name).alias("CATEGORY"), "REVENUE")
    return (part("Tickets", "fact_ticket_sales", "purchase_amount")
            .unionByName(part("F&B", "fact_food_beverage", "total_amount"))
            .unionByName(part("Rentals", "fact_rentals", "rental_amount")))


def n07_visits_by_segment(t: Tables) -> DataFrame:
    j = _pass_with_customer(t, "customer_segment")
    return j.groupBy(F.col("customer_segment").alias("CUSTOMER_SEGMENT")).agg(
        F.count(F.lit(1)).alias("VISITS")).orderBy(F.col("VISITS").desc(), "CUSTOMER_SEGMENT")


def _behavior_rows(t: Tables, *cols: str) -> DataFrame:
    """Row-level sem_customer_behavior (fact + date + customer), columns as named."""
    of_day = [c for c in cols if c in ("ski_season", "week_of_season")]
    of_customer = [c for c in cols if c in ("customer_segment", "is_pass_holder", "state", "age_group")]
    if hasattr(t, "narrow"):
        f = t.narrow("fact_pass_usage", ["date_key"], {"dim_customer": {c: c for c in of_customer}} if of_customer else None)
    else:
        f = t["fact_pass_usage"].select("date_key", "customer_key")
        f = f.join(_dim(t["dim_customer"], "customer_key", *of_customer), "customer_key", "left") if of_customer else f
    return f.join(_dim(t["dim_date"], "date_key", *of_day), "date_key", "left") if of_day else f


def n08_season_by_pass_holder(t: Tables) -> DataFrame:
    j = _behavior_rows(t, "ski_season", "is_pass_holder")
    return j.groupBy(F.col("ski_season").alias("SKI_SEASON"), F.col("is_pass_holder").alias("IS_PASS_HOLDER")).agg(
        F.count(F.lit(1)).alias("VISITS")).orderBy("SKI_SEASON", "IS_PASS_HOLDER")


def n08_top_states(t: Tables, k: int = 10) -> DataFrame:
    j = _behavior_rows(t, "state")
    return j.groupBy(F.col("state").alias("HOME_STATE")).agg(F.count(F.lit(1)).alias("VISITS")).orderBy(
        F.col("VISITS").desc(), "HOME_STATE").limit(k)


def n08_age_mix(t: Tables) -> DataFrame:
    j = _behavior_rows(t, "age_group", "customer_segment")
    return j.groupBy(F.col("age_group").alias("AGE_GROUP")).agg(
        F.count(F.lit(1)).alias("VISITS"), F.countDistinct("customer_segment").alias("SEGMENTS")
    ).orderBy(F.col("VISITS").desc(), "AGE_GROUP")


def n09_yoy_by_week_of_season(t: Tables) -> DataFrame:
    """Visits per (season, week of season) against the same week one season earlier."""
    j = _behavior_rows(t, "ski_season", "week_of_season").filter(F.col("ski_season").isNotNull())
    g = j.groupBy("ski_season", "week_of_season").agg(F.count(F.lit(1)).alias("VISITS"))
    start = F.substring("ski_season", 1, 4).cast("int")
    cur = g.withColumn("prev_season", F.concat((start - 1).cast("string"), F.lit("-"), start.cast("string")))
    prev = g.select(F.col("ski_season").alias("prev_season"), "week_of_season",
                    F.col("VISITS").alias("PREV_SEASON_VISITS"))
    out = cur.join(prev, ["prev_season", "week_of_season"], "left")
    return out.select(
        F.col("ski_season").alias("SKI_SEASON"), F.col("week_of_season").alias("WEEK_OF_SEASON"), "VISITS",
        "PREV_SEASON_VISITS",
        fround(safe_div(F.col("VISITS") - F.col("PREV_SEASON_VISITS"), F.col("PREV_SEASON_VISITS")) * 100, 2)
        .alias("YOY_GROWTH_PCT"),
    )


def n10_weekend_vs_weekday_waits(t: Tables) -> DataFrame:
    f = take(t, "fact_lift_scans", "date_key", "wait_time_minutes")
    d = _dim(t["dim_date"], "date_key", "is_weekend")
    return f.join(d, "date_key", "left").groupBy(F.col("is_weekend").alias("IS_WEEKEND")).agg(
        F.count(F.lit(1)).alias("SCANS"),
        fround(F.avg(F.col("wait_time_minutes").cast("double")), 4).alias("AVG_WAIT"))


def n10_hourly_profile(t: Tables) -> DataFrame:
    return take(t, "fact_lift_scans", "scan_hour", "wait_time_minutes").groupBy(F.col("scan_hour").alias("SCAN_HOUR")).agg(
        F.count(F.lit(1)).alias("SCANS"),
        fround(F.avg(F.col("wait_time_minutes").cast("double")), 4).alias("AVG_WAIT"),
    ).orderBy("SCAN_HOUR")


def _daily(df: DataFrame, date_col: str, **aggs) -> DataFrame:
    return df.groupBy(F.col(date_col).alias("day")).agg(*[v.alias(k) for k, v in aggs.items()])


def n11_weather_vs_attendance(t: Tables) -> DataFrame:
    """Daily visitors joined to daily weather, then their correlation per zone."""
    visits = _daily(take(t, "fact_pass_usage", "visit_date", "customer_id"), "visit_date", visitors=F.countDistinct("customer_id"))
    w = t["fact_weather"].select(F.col("weather_date").alias("day"), "mountain_zone", "snowfall_inches",
                                 "temp_high_f")
    j = w.join(visits, "day")
    return j.groupBy(F.col("mountain_zone").alias("MOUNTAIN_ZONE")).agg(
        F.count(F.lit(1)).alias("DAYS"),
        fround(F.corr(F.col("snowfall_inches"), F.col("visitors").cast("double")), 4).alias("CORR_SNOW_VISITORS"),
        fround(F.corr(F.col("temp_high_f"), F.col("visitors").cast("double")), 4).alias("CORR_TEMP_VISITORS"),
    )


def n12_snowfall_vs_revenue(t: Tables) -> DataFrame:
    rev = _daily(take(t, "fact_ticket_sales", "purchase_date", "purchase_amount"), "purchase_date", revenue=F.sum("purchase_amount").cast("double"))
    snow = t["fact_weather"].groupBy(F.col("weather_date").alias("day")).agg(
        F.max("snowfall_inches").alias("max_snowfall"))
    j = snow.join(rev, "day")
    return j.agg(F.count(F.lit(1)).alias("DAYS"),
                 fround(F.corr("max_snowfall", "revenue"), 4).alias("CORR_SNOW_REVENUE"))


def n13_monthly_trends(t: Tables) -> DataFrame:
    """Monthly NPS / satisfaction (feedback) and incident / patrol-response trends."""
    fb = t["fact_feedback"].groupBy(F.trunc("feedback_date", "month").alias("MONTH")).agg(
        fround(F.avg(F.col("nps_score").cast("double")), 4).alias("AVG_NPS"),
        fround(F.avg(F.col("rating").cast("double")), 4).alias("AVG_RATING"),
        F.count(F.lit(1)).alias("FEEDBACK_COUNT"))
    inc = t["fact_incidents"].groupBy(F.trunc("incident_date", "month").alias("MONTH")).agg(
        F.count(F.lit(1)).alias("INCIDENTS"),
        fround(F.avg(F.col("patrol_response_minutes").cast("double")), 4).alias("AVG_PATROL_RESPONSE"))
    return _combine(fb, inc, ["MONTH"])


def n14_revenue_per_visitor(t: Tables) -> DataFrame:
    """Drill-across: all revenue / unique visitors per season (never joins facts)."""
    rev = query(V.REVENUE, t, ["TOTAL_REVENUE"], ["SKI_SEASON"])
    vis = query(V.CUSTOMER_BEHAVIOR, t, ["UNIQUE_CUSTOMERS"], ["SKI_SEASON"])
    j = _combine(rev, vis, ["SKI_SEASON"])
    return j.select("SKI_SEASON", "TOTAL_REVENUE", "UNIQUE_CUSTOMERS",
                    safe_div("TOTAL_REVENUE", "UNIQUE_CUSTOMERS").alias("REVENUE_PER_VISITOR"))


def n15_pass_renewal_rate(t: Tables) -> DataFrame:
    f = t["fact_season_pass_sales"]
    return f.groupBy(F.col("valid_season").alias("VALID_SEASON")).agg(
        F.count(F.lit(1)).alias("PASSES_SOLD"),
        F.count(F.when(F.col("customer_type") == "Renewal", 1)).alias("RENEWALS"),
        (safe_div(F.count(F.when(F.col("customer_type") == "Renewal", 1)), F.count(F.lit(1))) * 100)
        .alias("RENEWAL_RATE_PCT"))


def n16_campaign_roi(t: Tables) -> DataFrame:
    c = t["stg_marketing_campaigns"]
    spend, rev = F.col("actual_spend").cast("double"), F.col("revenue_attributed").cast("double")
    return c.select(
        F.col("campaign_id").alias("CAMPAIGN_ID"), F.col("campaign_name").alias("CAMPAIGN_NAME"),
        spend.alias("SPEND"), rev.alias("REVENUE"),
        safe_div(rev - spend, spend).alias("ROI"),
        safe_div(rev, spend).alias("ROAS"))


def n17_campaign_funnel(t: Tables) -> DataFrame:
    tt = t["stg_campaign_touches"]

    def n(c):
        return F.count(F.when(F.col(c), 1))
    return tt.groupBy(F.col("campaign_id").alias("CAMPAIGN_ID")).agg(
        F.count(F.lit(1)).alias("TOUCHES"), n("was_delivered").alias("DELIVERED"), n("was_opened").alias("OPENED"),
        n("was_clicked").alias("CLICKED"), n("converted").alias("CONVERTED"),
        safe_div(n("was_opened"), n("was_delivered")).alias("OPEN_RATE"),
        safe_div(n("was_clicked"), n("was_opened")).alias("CLICK_THROUGH_RATE"),
        safe_div(n("converted"), n("was_clicked")).alias("CONVERSION_RATE"))


def n18_unknown_entity(t: Tables, segment: str = "no_such_segment") -> DataFrame:
    """A question about an entity that does not exist returns zero rows, not an error."""
    return query(V.CUSTOMER_BEHAVIOR, t, ["TOTAL_VISITS"], ["CUSTOMER_SEGMENT"],
                 filters=[lambda r: r("DIM_CUSTOMER", "customer_segment") == F.lit(segment)])
