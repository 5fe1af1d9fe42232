"""The declared data tests of the tables that the star builds, as a specification from which the
checks are made: key columns (unique and not null), required columns, foreign keys, value domains.
"""

from __future__ import annotations

from piste.operators.quality import Check

#: Keys that must be unique and not null.
KEYS = {
    "dim_date": ("date_key", "full_date"),
    "dim_customer": ("customer_key",),
    "dim_lift": ("lift_key", "lift_id"),
    "dim_location": ("location_key", "location_id"),
    "dim_product": ("product_key",),
    "dim_ticket_type": ("ticket_type_key",),
    "fact_lift_scans": ("scan_key",),
    "fact_pass_usage": ("usage_key",),
    "fact_ticket_sales": ("sale_key",),
    "fact_rentals": ("rental_key",),
    "fact_food_beverage": ("transaction_key",),
    "fact_weather": ("weather_key",),
    "fact_staffing": ("staffing_key",),
    "fact_marketing": ("marketing_key",),
    "fact_season_pass_sales": ("sale_id",),
    "fact_lessons": ("lesson_id",),
    "fact_incidents": ("incident_id",),
    "fact_feedback": ("feedback_id",),
    "stg_lift_scans": ("scan_id",),
    "stg_pass_usage": ("usage_id",),
    "stg_ticket_sales": ("sale_id",),
    "stg_rentals": ("rental_id",),
    "stg_food_beverage": ("transaction_id",),
    "stg_staffing_schedule": ("schedule_id",),
    "stg_marketing_touches": ("touch_id",),
    "stg_season_pass_sales": ("sale_id",),
    "stg_marketing_campaigns": ("campaign_id",),
    "stg_campaign_touches": ("touch_id",),
    "stg_ski_lessons": ("lesson_id",),
    "stg_incidents": ("incident_id",),
    "stg_customer_feedback": ("feedback_id",),
    "stg_instructors": ("instructor_id",),
}
#: Further columns that must not be null.
REQUIRED = {
    "dim_customer": ("customer_id", "is_current"),
    "dim_product": ("product_id",),
    "dim_ticket_type": ("ticket_type_id",),
    "fact_lift_scans": ("date_key",),
    "stg_lift_scans": ("customer_id", "lift_id", "scan_timestamp"),
    "stg_weather_conditions": ("weather_date", "mountain_zone"),
}
#: Foreign keys of facts, by the dimension key they refer to.
REFERENCES = {
    "fact_lift_scans": {"date_key": "date_key"},
    "fact_pass_usage": {"date_key": "date_key", "customer_key": "customer_key"},
    "fact_ticket_sales": {"purchase_date_key": "date_key", "customer_key": "customer_key", "location_key": "location_key", "ticket_type_key": "ticket_type_key"},
    "fact_rentals": {"rental_date_key": "date_key", "customer_key": "customer_key", "location_key": "location_key", "product_key": "product_key"},
    "fact_food_beverage": {"transaction_date_key": "date_key", "customer_key": "customer_key", "location_key": "location_key", "product_key": "product_key"},
}
#: Accepted domains.
DOMAINS = {
    ("stg_incidents", "incident_type"): ("collision", "fall", "equipment_failure", "medical", "lost_skier", "lift_issue"),
    ("stg_incidents", "severity"): ("minor", "moderate", "serious"),
    ("stg_customer_feedback", "sentiment"): ("positive", "neutral", "negative"),
}


def declared(available=None) -> list[Check]:
    """All declared checks, or those of the ``available`` tables."""
    checks = [Check(f"{kind}_{t}_{c}", kind, t, c) for t, keys in KEYS.items() for c in keys for kind in ("unique", "not_null")]
    checks += [Check(f"not_null_{t}_{c}", "not_null", t, c) for t, cols in REQUIRED.items() for c in cols]
    checks += [Check(f"relationships_{t}_{c}", "relationships", t, c, "dim_" + key.removesuffix("_key"), key)
               for t, keys in REFERENCES.items() for c, key in keys.items()]
    checks += [Check(f"accepted_values_{t}_{c}", "accepted_values", t, c, values=v) for (t, c), v in DOMAINS.items()]
    return [c for c in checks if available is None or c.table in available]
