"""Staging models ST01-ST24: typed projections with derived columns and key filters.

Each is ``DataFrame -> DataFrame`` and stays lazy; nothing is materialized.  Column
lists name the staged output; a raw frame may carry a subset (the driver adapters do),
in which case absent columns are skipped rather than invented.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piste.functions.core import dow0, hour_boundary_diff, year_boundary_diff


def _present(df: DataFrame, cols) -> list:
    have = set(df.columns)
    out = []
    for c in cols:
        if isinstance(c, str):
            if c in have:
                out.append(F.col(c))
        else:
            out.append(c)
    return out


def _met(raw: DataFrame) -> list[str]:
    """Dimension versions that the rows met before (operators/facts.py); they go along."""
    return [c for c in raw.columns if c.startswith("__")]


def _not_null(df: DataFrame, *cols: str) -> DataFrame:
    cond = None
    for c in cols:
        p = F.col(c).isNotNull()
        cond = p if cond is None else cond & p
    return df.filter(cond)


def _project(raw: DataFrame, cols, pk: str | None = None) -> DataFrame:
    df = _not_null(raw, pk) if pk else raw
    return df.select(*_present(raw, cols))


def _to_int(c: str) -> Column:
    # Casting a decimal to an integer rounds half away from zero in the warehouse;
    # Spark's cast truncates, so round first.
    return F.round(F.col(c)).cast("int")


# ST01
def stg_lift_scans(raw: DataFrame) -> DataFrame:
    ts = F.col("scan_timestamp")
    df = _not_null(raw, "scan_id", "customer_id", "lift_id", "scan_timestamp")
    return df.select(
        *_present(raw, ["scan_id", "customer_id", "lift_id", "scan_timestamp", "wait_time_minutes",
                        "temperature_f", "weather_condition"]),
        F.to_date(ts).alias("scan_date"),
        F.hour(ts).alias("scan_hour"),
        dow0(ts).alias("day_of_week"),
        *_present(raw, ["created_at"]),
        *_met(raw),
    )


# ST02
def stg_pass_usage(raw: DataFrame) -> DataFrame:
    d = F.col("visit_date")
    df = _not_null(raw, "usage_id", "customer_id", "visit_date")
    return df.select(
        *_present(raw, ["usage_id", "customer_id", "visit_date", "first_scan_time", "last_scan_time",
                        "total_lift_rides", "hours_on_mountain"]),
        dow0(d).alias("day_of_week"),
        dow0(d).isin(0, 6).alias("is_weekend"),
        *_present(raw, ["created_at"]),
    )


# ST03
def stg_ticket_sales(raw: DataFrame) -> DataFrame:
    ts = F.col("purchase_timestamp")
    pdate = F.to_date(ts)
    vfrom = F.col("valid_from_date")
    ch = F.col("purchase_channel")
    advance = (
        F.when((ch == "online") & (vfrom > pdate), True)
        .when((ch != "online") & (pdate < vfrom), True)
        .otherwise(False)
    )
    return _not_null(raw, "sale_id").select(
        *_present(raw, ["sale_id", "customer_id", "ticket_type_id", "location_id", "purchase_timestamp"]),
        pdate.alias("purchase_date"),
        F.hour(ts).alias("purchase_hour"),
        *_present(raw, ["valid_from_date", "valid_to_date"]),
        F.datediff(vfrom, pdate).alias("days_until_valid"),
        *_present(raw, ["purchase_amount", "payment_method", "purchase_channel"]),
        advance.alias("is_advance_purchase"),
        *_present(raw, ["created_at"]),
        *_met(raw),
    )


# ST04
def stg_rentals(raw: DataFrame) -> DataFrame:
    r, b = F.col("rental_timestamp"), F.col("return_timestamp")
    return _not_null(raw, "rental_id").select(
        *_present(raw, ["rental_id", "customer_id", "location_id", "product_id", "rental_timestamp"]),
        F.to_date(r).alias("rental_date"),
        F.hour(r).alias("rental_hour"),
        *_present(raw, ["return_timestamp"]),
        F.to_date(b).alias("return_date"),
        F.hour(b).alias("return_hour"),
        F.coalesce(F.to_date(b) == F.to_date(r), F.lit(False)).alias("returned_same_day"),
        *_present(raw, ["rental_duration_hours", "rental_amount", "created_at"]),
        *_met(raw),
    )


# ST05
def stg_food_beverage(raw: DataFrame) -> DataFrame:
    ts = F.col("transaction_timestamp")
    return _not_null(raw, "transaction_id").select(
        *_present(raw, ["transaction_id", "customer_id", "location_id", "product_id", "transaction_timestamp"]),
        F.to_date(ts).alias("transaction_date"),
        F.hour(ts).alias("transaction_hour"),
        *_present(raw, ["quantity", "unit_price", "total_amount", "payment_method", "created_at"]),
        *_met(raw),
    )


# ST06
def stg_weather_conditions(raw: DataFrame) -> DataFrame:
    snow, wind = F.col("snowfall_inches").cast("double"), F.col("wind_speed_mph").cast("double")
    return raw.select(
        F.to_date("weather_date").alias("weather_date"),
        *_present(raw, ["mountain_zone", "snow_condition"]),
        snow.alias("snowfall_inches"),
        F.col("base_depth_inches").cast("double").alias("base_depth_inches"),
        F.col("temp_high_f").cast("double").alias("temp_high_f"),
        F.col("temp_low_f").cast("double").alias("temp_low_f"),
        wind.alias("wind_speed_mph"),
        F.col("storm_warning").cast("boolean").alias("storm_warning"),
        F.coalesce(snow >= 6, F.lit(False)).alias("is_powder_day"),
        F.coalesce(wind >= 25, F.lit(False)).alias("is_high_wind"),
        F.col("created_at").cast("timestamp_ntz").alias("created_at"),
    )


# ST07
def stg_staffing_schedule(raw: DataFrame) -> DataFrame:
    cov = F.col("coverage_ratio").cast("double")
    return raw.select(
        *_present(raw, ["schedule_id", "location_id"]),
        F.to_date("schedule_date").alias("schedule_date"),
        F.col("shift_start").cast("timestamp_ntz").alias("shift_start"),
        F.col("shift_end").cast("timestamp_ntz").alias("shift_end"),
        *_present(raw, ["department", "job_role"]),
        F.col("scheduled_employees").cast("int").alias("scheduled_employees"),
        F.col("actual_employees").cast("int").alias("actual_employees"),
        cov.alias("coverage_ratio"),
        F.coalesce(cov < 0.9, F.lit(False)).alias("is_understaffed"),
        hour_boundary_diff("shift_start", "shift_end").alias("shift_hours"),
        F.col("created_at").cast("timestamp_ntz").alias("created_at"),
    )


# ST08
def stg_marketing_touches(raw: DataFrame) -> DataFrame:
    tc, cc = F.col("target_count").cast("int"), F.col("conversion_count").cast("int")
    rev = F.col("revenue_attributed").cast("double")
    return raw.select(
        *_present(raw, ["touch_id", "campaign_id", "campaign_name", "campaign_channel", "campaign_type",
                        "audience_segment"]),
        F.to_date("send_date").alias("sent_date"),
        tc.alias("target_count"),
        cc.alias("conversion_count"),
        F.col("open_rate").cast("double").alias("open_rate"),
        F.col("click_rate").cast("double").alias("click_rate"),
        rev.alias("revenue_attributed"),
        F.when(cc > 0, rev / cc).otherwise(F.lit(0.0)).alias("revenue_per_conversion"),
        F.when(tc > 0, cc.cast("double") / tc).otherwise(F.lit(0.0)).alias("conversion_rate"),
        F.col("created_at").cast("timestamp_ntz").alias("created_at"),
    )


def age_group(age: Column) -> Column:
    # Age bands Child < 18, Young Adult 18-34, Adult 35-54, Senior >= 55.
    return (
        F.when(age < 18, "Child")
        .when(age.between(18, 34), "Young Adult")
        .when(age.between(35, 54), "Adult")
        .when(age >= 55, "Senior")
        .otherwise("Unknown")
    )


# ST09
def stg_customers(raw: DataFrame, as_of: str) -> DataFrame:
    age = year_boundary_diff(F.col("birth_date"), F.lit(as_of).cast("date"))
    return _not_null(raw, "customer_id").select(
        *_present(raw, ["customer_id", "customer_name", "email", "phone", "birth_date"]),
        age.alias("age"),
        age_group(age).alias("age_group"),
        *_present(raw, ["customer_segment", "is_pass_holder", "pass_type", "first_visit_date", "home_zip_code",
                        "state", "created_at"]),
    )


def nps_category(nps: Column) -> Column:
    # Promoter >= 9, Passive >= 7, else Detractor.
    # NULL falls through to the ELSE arm on purpose (reproduced as written).
    return F.when(nps >= 9, "Promoter").when(nps >= 7, "Passive").otherwise("Detractor")


# ST10
def stg_customer_feedback(raw: DataFrame) -> DataFrame:
    nps = F.col("nps_score").cast("int")
    return _not_null(raw, "feedback_id").select(
        *_present(raw, ["feedback_id", "customer_id", "survey_id"]),
        *[F.to_date(c).alias(c) for c in ("feedback_date", "visit_date", "response_date", "resolution_date")
          if c in raw.columns],
        *_present(raw, ["feedback_type", "category", "subcategory", "source"]),
        nps.alias("nps_score"),
        *[F.col(c).cast(t).alias(c) for c, t in (("satisfaction_score", "double"), ("likelihood_to_return", "int"),
                                                 ("likelihood_to_recommend", "int"), ("sentiment_score", "double"))
          if c in raw.columns],
        *_present(raw, ["sentiment"]),
        nps_category(nps).alias("nps_category"),
        *_present(raw, ["feedback_text", "response_text", "responded_by"]),
        *[F.col(c).cast("boolean").alias(c) for c in ("resolved", "escalated") if c in raw.columns],
        *_present(raw, ["created_at"]),
    )


def staging_severity_score(sev: Column) -> Column:
    # Lower-case severity domain of the staging model.
    return F.when(sev == "minor", 1).when(sev == "moderate", 2).when(sev == "serious", 3).otherwise(0)


# ST11
def stg_incidents(raw: DataFrame) -> DataFrame:
    flags = ("weather_factor", "equipment_factor", "first_aid_rendered", "transport_required",
             "followup_required", "report_filed")
    return _not_null(raw, "incident_id").select(
        *_present(raw, ["incident_id", "customer_id", "location_id", "lift_id"]),
        F.to_date("incident_date").alias("incident_date"),
        *_present(raw, ["incident_time"]),
        F.col("incident_timestamp").cast("timestamp_ntz").alias("incident_timestamp"),
        *_present(raw, ["trail_name", "incident_type", "severity", "description", "cause"]),
        staging_severity_score(F.col("severity")).alias("severity_score"),
        *[_to_int(c).alias(c) for c in ("customer_age",) if c in raw.columns],
        *_present(raw, ["customer_skill_level"]),
        *[F.col(c).cast("boolean").alias(c) for c in flags[:4] if c in raw.columns],
        *_present(raw, ["transport_type"]),
        _to_int("patrol_response_minutes").alias("patrol_response_minutes"),
        *_present(raw, ["resolution"]),
        *[F.col(c).cast("boolean").alias(c) for c in flags[4:] if c in raw.columns],
        *_present(raw, ["created_at"]),
    )


# ST12
def stg_grooming_logs(raw: DataFrame) -> DataFrame:
    improved = F.col("conditions_after").isin("excellent", "good") & F.col("conditions_before").isin(
        "poor", "fair", "icy")
    return _not_null(raw, "log_id").select(
        *_present(raw, ["log_id", "groomer_id", "machine_id"]),
        F.to_date("grooming_date").alias("grooming_date"),
        *_present(raw, ["start_time", "end_time", "shift", "trail_name", "grooming_type", "duration_minutes"]),
        F.col("snow_depth_inches").cast("double").alias("snow_depth_inches"),
        *_present(raw, ["conditions_before", "conditions_after"]),
        F.coalesce(improved, F.lit(False)).alias("condition_improved"),
        *_present(raw, ["fuel_used_gallons", "notes", "created_at"]),
    )


def occupancy_tier(pct: Column) -> Column:
    # Full >= 95, High >= 80, Moderate >= 50, Low >= 20, else Empty.
    return (
        F.when(pct >= 95, "Full").when(pct >= 80, "High").when(pct >= 50, "Moderate")
        .when(pct >= 20, "Low").otherwise("Empty")
    )


# ST13
def stg_parking_occupancy(raw: DataFrame) -> DataFrame:
    pct = F.col("occupancy_percent").cast("double")
    return _not_null(raw, "record_id").select(
        *_present(raw, ["record_id", "lot_id"]),
        F.to_date("record_date").alias("record_date"),
        F.col("record_hour").cast("int").alias("record_hour"),
        *_present(raw, ["lot_name"]),
        F.col("total_spaces").cast("int").alias("total_spaces"),
        F.col("occupied_spaces").cast("int").alias("occupied_spaces"),
        (F.col("total_spaces") - F.col("occupied_spaces")).cast("int").alias("available_spaces"),
        pct.alias("occupancy_percent"),
        occupancy_tier(pct).alias("occupancy_tier"),
        *_present(raw, ["vehicles_entered", "vehicles_exited", "revenue_collected", "overflow_active", "created_at"]),
    )


# ST14-ST24: projections (+ key filter where the model has one)
def stg_parking_lots(raw):
    return _project(raw, ["lot_id", "lot_name", "lot_type", "total_spaces", "hourly_rate", "daily_max",
                          "distance_to_lifts_feet", "has_shuttle", "elevation_zone", "created_at"])


def stg_season_pass_sales(raw):
    return _project(raw, ["sale_id", "customer_id", "ticket_type_id", "purchase_date", "valid_season",
                          "purchase_amount", "original_price", "discount_amount", "payment_method",
                          "purchase_channel", "is_renewal", "previous_pass_type", "promo_code", "campaign_id",
                          "payment_plan", "payment_plan_months", "created_at"])


def stg_ski_lessons(raw):
    return _project(raw, ["lesson_id", "customer_id", "lesson_date", "lesson_start_time", "lesson_type",
                          "sport_type", "skill_level", "duration_hours", "instructor_id", "group_size",
                          "lesson_amount", "rental_included", "rental_amount", "tip_amount", "booking_channel",
                          "booking_lead_days", "completed", "cancellation_reason", "student_rating", "created_at"])


def stg_campaign_touches(raw):
    return _project(raw, ["touch_id", "customer_id", "campaign_id", "channel", "touch_timestamp",
                          "was_delivered", "was_opened", "open_timestamp", "was_clicked", "click_timestamp",
                          "click_url", "converted", "conversion_timestamp", "conversion_type",
                          "conversion_value", "conversion_sale_id", "unsubscribed", "created_at"])


def stg_employees(raw):
    return _project(raw, ["employee_id", "employee_name", "department", "job_title", "hire_date",
                          "termination_date", "employment_type", "hourly_rate", "certifications",
                          "emergency_contact", "is_supervisor", "reports_to", "created_at"])


def stg_instructors(raw):
    return raw


def stg_marketing_campaigns(raw):
    return raw


def stg_lifts(raw):
    return _project(raw, ["lift_id", "lift_name", "lift_type", "capacity_per_hour", "vertical_feet",
                          "terrain_type", "base_elevation", "top_elevation", "difficulty_access"], pk="lift_id")


def stg_locations(raw):
    return _project(raw, ["location_id", "location_name", "location_type", "venue_size", "seating_capacity",
                          "elevation_zone"], pk="location_id")


def stg_products(raw):
    return _project(raw, ["product_id", "product_name", "product_category", "product_type", "price"],
                    pk="product_id")


def stg_ticket_types(raw):
    return _project(raw, ["ticket_type_id", "ticket_name", "ticket_category", "duration_days", "access_level",
                          "price", "blackout_dates"], pk="ticket_type_id")
