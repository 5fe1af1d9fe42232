"""Facts F01-F13: staged events enriched with dimension keys and attributes.

Pure ``DataFrame -> DataFrame`` builders.  The incremental machinery (high-water mark,
upsert) lives in :mod:`piste.operators.incremental` and wraps these.

Key styles are reproduced as the reference defines them: F01-F05 hash the natural key
(customer/lift/location/product) even when the dimension row is missing, so keys are
never NULL but may dangle; F06-F08 take keys from the joined dimension, so a miss is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piste.functions.core import NULL_KEY_TOKEN, date_key, surrogate_key, ts_text



def _sel(df: DataFrame, *cols) -> DataFrame:
    """Select the named output columns that the input carries (raw tables bound from the
    driver data supply a subset of the warehouse columns) plus computed expressions."""
    have = set(df.columns)
    return df.select(*[c for c in cols if not isinstance(c, str) or c in have])


def _lit_ts(s: str) -> Column:
    return F.lit(s).cast("timestamp_ntz")


Need = set[str] | None
Carry = dict[str, dict[str, str]] | None

#: The dimensions that a fact looks up by natural id, with the fact's key column of each.
CARRIES = {
    "fact_lift_scans": {"dim_customer": "customer_key"},
    "fact_pass_usage": {"dim_customer": "customer_key"},
    "fact_ticket_sales": {"dim_customer": "customer_key", "dim_ticket_type": "ticket_type_key"},
    "fact_rentals": {"dim_customer": "customer_key", "dim_product": "product_key"},
    "fact_food_beverage": {"dim_customer": "customer_key", "dim_product": "product_key"},
}


def _current(dim: DataFrame, id_col: str, cols: list[tuple[str, str]]) -> DataFrame:
    """Narrow the current version of a dimension to ``id`` + renamed columns."""
    d = dim.filter(F.col("is_current")) if "is_current" in dim.columns else dim
    return d.select(F.col(id_col).alias(f"__{id_col}"), *[F.col(k).alias(v) for k, v in cols])


def _version_key(natural: str, dim_key: str) -> Column:
    """Key of (natural id, version start) as the reference hashes it.

    When the dimension matched, that hash *is* the dimension's own key, so it is taken
    from the join instead of re-hashed per fact row; only dangling rows hash the id
    with the NULL token.
    """
    dangling = F.md5(F.concat_ws("-", F.coalesce(F.col(natural).cast("string"), F.lit(NULL_KEY_TOKEN)),
                                 F.lit(NULL_KEY_TOKEN)))
    return F.coalesce(F.col(dim_key), dangling)


def meet(df: DataFrame, on: str, dim: DataFrame, id_col: str, *attributes: str) -> DataFrame:
    """``df`` with what lookups need of the dimension's current versions, met by the column ``on``: the
    start of each version of the row's id, and ``attributes`` beside, as one array.

    Rows are neither lost nor added, so they can be shuffled narrow, staged, and turned into several
    tables; a lookup takes the array apart later (``_taken_apart``).
    """
    d = _current(dim, id_col, [(c, c) for c in ("valid_from", *attributes)])
    met = d.where(F.col(f"__{id_col}").isNotNull()).groupBy(f"__{id_col}").agg(F.collect_list(F.struct("valid_from", *attributes)).alias(f"__{id_col}_versions"))
    return df.join(met, df[on] == met[f"__{id_col}"], "left").drop(f"__{id_col}")


def _taken_apart(df: DataFrame, id_col: str, cols: dict[str, str]) -> DataFrame:
    """A row per version that ``meet`` brought, or one without any: what the left join gives.  The
    dimension's key is hashed from the id and the start, as the dimension itself does."""
    met, key = f"__{id_col}_versions", f"{id_col.removesuffix('_id')}_key"
    given = df.schema[met].dataType.elementType.names
    apart = df.select(*[c for c in df.columns if c != met], F.explode_outer(met).alias("__version"))
    of = F.col("__version")
    values = [(surrogate_key(F.col(id_col), ts_text(of["valid_from"])) if k == key else of[k]).alias(v) for k, v in cols.items() if k == key or k in given]
    return apart.select(*[c for c in apart.columns if c != "__version"], *values)


def _lookup(df: DataFrame, dim: DataFrame, id_col: str, cols: dict[str, str], uses: set[str], need: Need, carry: dict[str, str] | None) -> DataFrame:
    """``df`` with columns of the dimension's current version, and those to ``carry`` beside.

    Left out altogether when none of the fact's columns that use it is needed: a left join on a
    dimension's id adds no rows, but no planner may assume that.
    """
    if need is not None and not carry and not need & uses:
        return df
    if f"__{id_col}_versions" in df.columns:
        return _taken_apart(df, id_col, cols | (carry or {}))
    d = _current(dim, id_col, [*cols.items(), *(carry or {}).items()])
    return df.join(d, df[id_col] == d[f"__{id_col}"], "left").drop(f"__{id_col}")


def _customer_key() -> Column:
    return _version_key("customer_id", "__c_key")


def _with_customer(stg: DataFrame, dim_customer: DataFrame, need: Need, carry: Carry) -> DataFrame:
    return _lookup(stg, dim_customer, "customer_id", {"customer_key": "__c_key"}, {"customer_key"}, need, (carry or {}).get("dim_customer"))


def _columns(df: DataFrame, need: Need, carry: Carry, plain: str, **computed: Column) -> DataFrame:
    """The fact's ``computed`` and ``plain`` (passed through) columns, or those needed, and what it carries."""
    out = computed | {c: F.col(c) for c in plain.split()}
    return df.select(*[c.alias(n) for n, c in out.items() if need is None or n in need], *[a for spec in (carry or {}).values() for a in spec.values()])


# F01
def fact_lift_scans(stg: DataFrame, dim_customer: DataFrame, load_ts: str, need: Need = None, carry: Carry = None) -> DataFrame:
    return _columns(
        _with_customer(stg, dim_customer, need, carry), need, carry,
        "scan_id customer_id lift_id scan_timestamp wait_time_minutes temperature_f weather_condition scan_hour day_of_week",
        scan_key=surrogate_key(F.col("scan_id")), date_key=date_key("scan_date"), customer_key=_customer_key(),
        lift_key=surrogate_key(F.col("lift_id")), created_at=_lit_ts(load_ts))


# F02
def fact_pass_usage(stg: DataFrame, dim_customer: DataFrame, load_ts: str, need: Need = None, carry: Carry = None) -> DataFrame:
    return _columns(
        _with_customer(stg, dim_customer, need, carry), need, carry,
        "usage_id customer_id visit_date first_scan_time last_scan_time total_lift_rides hours_on_mountain is_weekend",
        usage_key=surrogate_key(F.col("usage_id")), date_key=date_key("visit_date"), customer_key=_customer_key(), created_at=_lit_ts(load_ts))


# F03
def fact_ticket_sales(stg: DataFrame, dim_customer: DataFrame, dim_ticket_type: DataFrame, need: Need = None, carry: Carry = None) -> DataFrame:
    s = _lookup(_with_customer(stg, dim_customer, need, carry), dim_ticket_type, "ticket_type_id",
                {"ticket_type_key": "__tt_key", "ticket_category": "ticket_category", "access_level": "access_level", "price": "list_price"},
                {"ticket_type_key", "ticket_category", "access_level", "list_price", "discount_amount"}, need, (carry or {}).get("dim_ticket_type"))
    return _columns(
        s, need, carry,
        "sale_id customer_id ticket_type_id location_id purchase_timestamp purchase_date purchase_hour valid_from_date valid_to_date "
        "days_until_valid purchase_amount payment_method purchase_channel is_advance_purchase created_at ticket_category access_level list_price",
        sale_key=surrogate_key(F.col("sale_id")), purchase_date_key=date_key("purchase_date"), customer_key=_customer_key(),
        location_key=surrogate_key(F.col("location_id")), ticket_type_key=_version_key("ticket_type_id", "__tt_key"),
        discount_amount=F.col("list_price") - F.col("purchase_amount"))


_PRODUCT = {"product_key": "__p_key", "product_category": "product_category", "product_type": "product_type", "price": "list_price"}
_OF_PRODUCT = {"product_key", "product_category", "product_type", "list_price"}


# F04
def fact_rentals(stg: DataFrame, dim_customer: DataFrame, dim_product: DataFrame, need: Need = None, carry: Carry = None) -> DataFrame:
    s = _lookup(_with_customer(stg, dim_customer, need, carry), dim_product, "product_id", _PRODUCT, _OF_PRODUCT | {"rental_markup"}, need,
                (carry or {}).get("dim_product"))
    return _columns(
        s, need, carry,
        "rental_id customer_id location_id product_id rental_timestamp rental_date rental_hour return_timestamp return_date return_hour "
        "returned_same_day rental_duration_hours rental_amount created_at product_category product_type list_price",
        rental_key=surrogate_key(F.col("rental_id")), rental_date_key=date_key("rental_date"), return_date_key=date_key("return_date"),
        customer_key=_customer_key(), location_key=surrogate_key(F.col("location_id")), product_key=_version_key("product_id", "__p_key"),
        rental_markup=F.col("rental_amount") - F.col("list_price"))


# F05
def fact_food_beverage(stg: DataFrame, dim_customer: DataFrame, dim_product: DataFrame, need: Need = None, carry: Carry = None) -> DataFrame:
    s = _lookup(_with_customer(stg, dim_customer, need, carry), dim_product, "product_id", _PRODUCT, _OF_PRODUCT | {"upsell_amount"}, need,
                (carry or {}).get("dim_product"))
    return _columns(
        s, need, carry,
        "transaction_id customer_id location_id product_id transaction_timestamp transaction_date transaction_hour quantity unit_price "
        "total_amount payment_method created_at product_category product_type list_price",
        transaction_key=surrogate_key(F.col("transaction_id")), transaction_date_key=date_key("transaction_date"), customer_key=_customer_key(),
        location_key=surrogate_key(F.col("location_id")), product_key=_version_key("product_id", "__p_key"),
        upsell_amount=F.col("total_amount") - F.col("quantity") * F.col("list_price"))


def _date_lookup(df: DataFrame, dim_date: DataFrame, on: str, out: str = "date_key") -> DataFrame:
    d = dim_date.select(F.col("full_date").alias("__full_date"), F.col("date_key").alias(out))
    return df.join(F.broadcast(d), df[on] == F.col("__full_date"), "left").drop("__full_date")


# F06
def fact_weather(stg: DataFrame, dim_date: DataFrame) -> DataFrame:
    w = _date_lookup(stg, dim_date, "weather_date")
    return _sel(w, 
        surrogate_key(F.col("weather_date").cast("string"), F.col("mountain_zone")).alias("weather_key"),
        "date_key", "weather_date", "mountain_zone", "snow_condition", "snowfall_inches", "base_depth_inches",
        "temp_high_f", "temp_low_f", "wind_speed_mph", "storm_warning", "is_powder_day", "is_high_wind",
        ((F.col("temp_high_f") + F.col("temp_low_f")) / 2).alias("avg_temp_f"),
        (F.col("temp_high_f") - F.col("temp_low_f")).alias("temp_range_f"),
        "created_at",
    )


# F07
def fact_staffing(stg: DataFrame, dim_date: DataFrame, dim_location: DataFrame) -> DataFrame:
    s = _date_lookup(stg, dim_date, "schedule_date")
    loc = dim_location.select(F.col("location_id").alias("__location_id"), "location_key")
    s = s.join(loc, s.location_id == loc.__location_id, "left")
    return _sel(s, 
        surrogate_key(F.col("schedule_id")).alias("staffing_key"),
        "date_key", "location_key", "schedule_id", "schedule_date", "department", "job_role", "shift_start",
        "shift_end", "shift_hours", "scheduled_employees", "actual_employees", "coverage_ratio", "is_understaffed",
        (F.col("scheduled_employees") - F.col("actual_employees")).alias("staff_variance"),
        (F.col("scheduled_employees") * F.col("shift_hours")).alias("scheduled_labor_hours"),
        (F.col("actual_employees") * F.col("shift_hours")).alias("actual_labor_hours"),
        "created_at",
    )


# F08
def fact_marketing(stg: DataFrame, dim_date: DataFrame) -> DataFrame:
    m = _date_lookup(stg, dim_date, "sent_date", "send_date_key")
    tc = F.col("target_count")
    return _sel(m, 
        surrogate_key(F.col("touch_id")).alias("marketing_key"),
        "send_date_key", "touch_id", "campaign_id", "sent_date", "campaign_name", "campaign_channel",
        "campaign_type", "audience_segment", "target_count", "conversion_count", "open_rate", "click_rate",
        "conversion_rate", "revenue_attributed", "revenue_per_conversion",
        F.when(tc > 0, F.col("revenue_attributed") / tc).otherwise(F.lit(0.0)).alias("revenue_per_target"),
        (tc * F.col("open_rate")).alias("estimated_opens"),
        (tc * F.col("click_rate")).alias("estimated_clicks"),
        "created_at",
    )


def _segment_lookup(df: DataFrame, stg_customers: DataFrame) -> DataFrame:
    c = stg_customers.select(F.col("customer_id").alias("__customer_id"), "customer_segment")
    return df.join(c, df.customer_id == c.__customer_id, "left").drop("__customer_id")


# F09
def fact_season_pass_sales(stg: DataFrame, stg_customers: DataFrame, campaigns: DataFrame) -> DataFrame:
    s = _segment_lookup(stg, stg_customers)
    camp = campaigns.select(F.col("campaign_id").alias("__campaign_id"), "campaign_name",
                                              "campaign_type")
    s = s.join(camp, s.campaign_id == camp.__campaign_id, "left")
    op, amt = F.col("original_price"), F.col("purchase_amount")
    return _sel(s, 
        "sale_id", "customer_id", "customer_segment", "ticket_type_id", "purchase_date", "valid_season",
        "purchase_amount", "original_price", "discount_amount", "payment_method", "purchase_channel",
        "is_renewal", "previous_pass_type", "promo_code", "campaign_id", "campaign_name", "campaign_type",
        "payment_plan", "payment_plan_months",
        F.when(op > 0, F.round((op - amt) / op * 100, 2)).otherwise(F.lit(0.0)).alias("discount_percent"),
        F.when(F.col("is_renewal"), "Renewal").otherwise("New").alias("customer_type"),
        "created_at",
    )


# F10
def fact_lessons(stg: DataFrame, stg_customers: DataFrame, instructors: DataFrame) -> DataFrame:
    s = _segment_lookup(stg, stg_customers)
    ins = instructors.select(
        F.col("instructor_id").alias("__instructor_id"), "instructor_name",
        F.col("certification_level").alias("instructor_certification"),
        F.col("avg_rating").alias("instructor_rating"))
    s = s.join(ins, s.instructor_id == ins.__instructor_id, "left")
    total = F.col("lesson_amount") + F.coalesce(F.col("rental_amount"), F.lit(0)) + F.coalesce(
        F.col("tip_amount"), F.lit(0))
    return _sel(s, 
        "lesson_id", "customer_id", "customer_segment", "lesson_date", "lesson_start_time", "lesson_type",
        "sport_type", "skill_level", "duration_hours", "instructor_id", "instructor_name",
        "instructor_certification", "instructor_rating", "group_size", "lesson_amount", "rental_included",
        "rental_amount", "tip_amount", total.alias("total_lesson_revenue"), "booking_channel",
        "booking_lead_days", "completed", "cancellation_reason", "student_rating", "created_at",
    )


def fact_severity_score(sev: Column) -> Column:
    # Title-Case severity domain of the fact model (no 'Major'; see B2).
    return (F.when(sev == "Minor", 1).when(sev == "Moderate", 2).when(sev == "Serious", 3)
            .when(sev == "Critical", 4).otherwise(0))


# F11
def fact_incidents(stg: DataFrame, stg_customers: DataFrame) -> DataFrame:
    s = _segment_lookup(stg, stg_customers)
    return _sel(s, 
        "incident_id", "incident_date", "incident_time", "incident_type", "severity", "location_id", "lift_id",
        "trail_name", "customer_id", "customer_segment", "customer_age", "customer_skill_level", "description",
        "cause", "weather_factor", "equipment_factor", "first_aid_rendered", "transport_required",
        "patrol_response_minutes", "resolution", "followup_required",
        fact_severity_score(F.col("severity")).alias("severity_score"),
        "created_at",
    )


# F12
def fact_feedback(stg: DataFrame, stg_customers: DataFrame) -> DataFrame:
    s = _segment_lookup(stg, stg_customers)
    fd, rd = F.col("feedback_date"), F.col("response_date")
    return _sel(s, 
        "feedback_id", "customer_id", "customer_segment", "feedback_date", "visit_date", "feedback_type",
        "category", "subcategory", F.col("satisfaction_score").alias("rating"), "sentiment", "sentiment_score",
        "feedback_text", "response_text", "response_date", "responded_by", "resolved", "resolution_date",
        "nps_score", "likelihood_to_recommend", "likelihood_to_return", "source",
        F.when(rd.isNotNull() & fd.isNotNull(), F.datediff(rd, fd)).alias("response_time_days"),
        "created_at",
    )


def occupancy_status(pct: Column) -> Column:
    # Full >= 95, Near Full >= 80, Moderate >= 50, else Light.
    return F.when(pct >= 95, "Full").when(pct >= 80, "Near Full").when(pct >= 50, "Moderate").otherwise("Light")


# F13
def fact_parking(stg: DataFrame, stg_lots: DataFrame) -> DataFrame:
    lots = stg_lots.select(
        F.col("lot_id").alias("__lot_id"), F.col("lot_name").alias("lot_name_dim"), "lot_type",
        F.col("total_spaces").alias("lot_capacity"), F.col("daily_max").alias("daily_rate"), "has_shuttle",
        "distance_to_lifts_feet")
    s = stg.join(lots, stg.lot_id == lots.__lot_id, "left")
    return _sel(s, 
        "record_id", "record_date", "record_hour", "lot_id", "lot_name_dim", "lot_type", "lot_capacity",
        "daily_rate", "has_shuttle", "distance_to_lifts_feet", "lot_name", "total_spaces", "occupied_spaces",
        "occupancy_percent", "vehicles_entered", "vehicles_exited", "revenue_collected", "overflow_active",
        occupancy_status(F.col("occupancy_percent")).alias("occupancy_status"),
        "created_at",
    )
