"""Declared schemas of the raw resort tables (SRC01), as Spark DDL.

Money columns are exact decimals as in the warehouse; ``TIME`` columns are strings
(``HH:mm:ss``) because Spark's TIME type is off by default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TS = "timestamp_ntz"

# Column lists and types of the raw tables.
RAW_DDL: dict[str, str] = {
    "customers": f"customer_id string, customer_name string, email string, phone string, birth_date date, "
                 f"customer_segment string, is_pass_holder boolean, pass_type string, first_visit_date date, "
                 f"home_zip_code string, state string, acquisition_date date, acquisition_channel string, "
                 f"acquisition_campaign_id string, acquisition_source string, lifetime_value decimal(10,2), "
                 f"total_visits bigint, total_spend decimal(10,2), avg_spend_per_visit decimal(10,2), "
                 f"last_visit_date date, churn_risk_score decimal(3,2), preferred_channel string, "
                 f"email_opt_in boolean, sms_opt_in boolean, created_at {TS}",
    "lifts": "lift_id string, lift_name string, lift_type string, capacity_per_hour bigint, vertical_feet bigint, "
             "terrain_type string, base_elevation bigint, top_elevation bigint, difficulty_access string",
    "locations": "location_id string, location_name string, location_type string, venue_size string, "
                 "seating_capacity bigint, elevation_zone string",
    "products": "product_id string, product_name string, product_category string, product_type string, "
                "price decimal(10,2)",
    "ticket_types": "ticket_type_id string, ticket_name string, ticket_category string, duration_days bigint, "
                    "access_level string, price decimal(10,2), blackout_dates string",
    "instructors": f"instructor_id string, instructor_name string, certification_level string, specialties string, "
                   f"languages string, sport_type string, hire_date date, hourly_rate decimal(6,2), "
                   f"avg_rating decimal(3,2), total_lessons bigint, active boolean, created_at {TS}",
    "parking_lots": f"lot_id string, lot_name string, lot_type string, total_spaces int, hourly_rate decimal(6,2), "
                    f"daily_max decimal(6,2), distance_to_lifts_feet int, has_shuttle boolean, elevation_zone string, "
                    f"created_at {TS}",
    "employees": f"employee_id string, employee_name string, department string, job_title string, hire_date date, "
                 f"termination_date date, employment_type string, hourly_rate decimal(6,2), certifications string, "
                 f"emergency_contact string, home_zip string, is_supervisor boolean, reports_to string, "
                 f"active boolean, created_at {TS}",
    "lift_scans": f"scan_id string, customer_id string, lift_id string, scan_timestamp {TS}, "
                  f"wait_time_minutes decimal(5,1), temperature_f bigint, weather_condition string, created_at {TS}",
    "pass_usage": f"usage_id string, customer_id string, visit_date date, first_scan_time {TS}, last_scan_time {TS}, "
                  f"total_lift_rides bigint, hours_on_mountain decimal(5,2), created_at {TS}",
    "ticket_sales": f"sale_id string, customer_id string, ticket_type_id string, location_id string, "
                    f"purchase_timestamp {TS}, valid_from_date date, valid_to_date date, "
                    f"purchase_amount decimal(10,2), payment_method string, purchase_channel string, "
                    f"promo_code string, campaign_id string, created_at {TS}",
    "season_pass_sales": f"sale_id string, customer_id string, ticket_type_id string, purchase_date date, "
                         f"valid_season string, purchase_amount decimal(10,2), original_price decimal(10,2), "
                         f"discount_amount decimal(10,2), payment_method string, purchase_channel string, "
                         f"is_renewal boolean, previous_pass_type string, promo_code string, campaign_id string, "
                         f"payment_plan boolean, payment_plan_months int, created_at {TS}",
    "rentals": f"rental_id string, customer_id string, location_id string, product_id string, "
               f"rental_timestamp {TS}, return_timestamp {TS}, rental_duration_hours decimal(5,2), "
               f"rental_amount decimal(10,2), deposit_amount decimal(10,2), damage_reported boolean, created_at {TS}",
    "food_beverage": f"transaction_id string, customer_id string, location_id string, product_id string, "
                     f"transaction_timestamp {TS}, quantity bigint, unit_price decimal(10,2), "
                     f"total_amount decimal(10,2), payment_method string, is_combo boolean, created_at {TS}",
    "marketing_campaigns": f"campaign_id string, campaign_name string, campaign_type string, channel string, "
                           f"target_audience string, start_date date, end_date date, budget decimal(10,2), "
                           f"actual_spend decimal(10,2), impressions bigint, clicks bigint, unique_visitors bigint, "
                           f"conversions bigint, revenue_attributed decimal(10,2), "
                           f"cost_per_acquisition decimal(10,2), return_on_ad_spend decimal(5,2), "
                           f"creative_variant string, landing_page string, utm_source string, utm_medium string, "
                           f"utm_campaign string, created_at {TS}",
    "customer_campaign_touches": f"touch_id string, customer_id string, campaign_id string, touch_date date, "
                                 f"touch_timestamp {TS}, channel string, was_delivered boolean, was_opened boolean, "
                                 f"open_timestamp {TS}, was_clicked boolean, click_timestamp {TS}, click_url string, "
                                 f"converted boolean, conversion_timestamp {TS}, conversion_type string, "
                                 f"conversion_value decimal(10,2), conversion_sale_id string, unsubscribed boolean, "
                                 f"bounce_type string, created_at {TS}",
    "marketing_touches": f"touch_id string, campaign_id string, campaign_name string, campaign_channel string, "
                         f"campaign_type string, audience_segment string, send_date date, target_count bigint, "
                         f"open_rate decimal(5,4), click_rate decimal(5,4), conversion_count bigint, "
                         f"revenue_attributed decimal(12,2), created_at {TS}",
    "weather_conditions": f"weather_date date, mountain_zone string, snow_condition string, "
                          f"snowfall_inches decimal(5,2), base_depth_inches decimal(5,2), temp_high_f decimal(5,1), "
                          f"temp_low_f decimal(5,1), wind_speed_mph decimal(5,1), visibility string, uv_index int, "
                          f"storm_warning boolean, avalanche_risk string, created_at {TS}",
    "staffing_schedule": f"schedule_id string, schedule_date date, location_id string, department string, "
                         f"job_role string, employee_id string, scheduled_employees int, actual_employees int, "
                         f"coverage_ratio decimal(5,2), shift_start {TS}, shift_end {TS}, "
                         f"overtime_hours decimal(4,1), created_at {TS}",
    "ski_lessons": f"lesson_id string, customer_id string, lesson_date date, lesson_start_time string, "
                   f"lesson_type string, sport_type string, skill_level string, duration_hours decimal(3,1), "
                   f"instructor_id string, group_size int, lesson_amount decimal(10,2), rental_included boolean, "
                   f"rental_amount decimal(10,2), tip_amount decimal(10,2), booking_channel string, "
                   f"booking_lead_days int, completed boolean, cancellation_reason string, "
                   f"student_rating decimal(2,1), created_at {TS}",
    "incidents": f"incident_id string, incident_date date, incident_time string, incident_timestamp {TS}, "
                 f"incident_type string, severity string, location_id string, lift_id string, trail_name string, "
                 f"customer_id string, customer_age int, customer_skill_level string, description string, "
                 f"cause string, weather_factor boolean, equipment_factor boolean, first_aid_rendered boolean, "
                 f"transport_required boolean, transport_type string, patrol_response_minutes decimal(4,1), "
                 f"resolution string, followup_required boolean, report_filed boolean, created_at {TS}",
    "customer_feedback": f"feedback_id string, customer_id string, feedback_date date, feedback_type string, "
                         f"survey_id string, nps_score int, satisfaction_score int, likelihood_to_return int, "
                         f"likelihood_to_recommend int, category string, subcategory string, sentiment string, "
                         f"sentiment_score decimal(3,2), feedback_text string, response_text string, "
                         f"response_date date, responded_by string, resolved boolean, resolution_date date, "
                         f"escalated boolean, source string, visit_date date, created_at {TS}",
    "parking_occupancy": f"record_id string, record_date date, record_hour int, lot_id string, lot_name string, "
                         f"total_spaces int, occupied_spaces int, occupancy_percent decimal(5,2), "
                         f"vehicles_entered int, vehicles_exited int, revenue_collected decimal(10,2), "
                         f"overflow_active boolean, created_at {TS}",
    "grooming_logs": f"log_id string, grooming_date date, shift string, trail_name string, groomer_id string, "
                     f"machine_id string, start_time {TS}, end_time {TS}, duration_minutes int, "
                     f"grooming_type string, snow_depth_inches decimal(4,1), conditions_before string, "
                     f"conditions_after string, fuel_used_gallons decimal(5,1), notes string, created_at {TS}",
    "lift_maintenance": f"maintenance_id string, lift_id string, maintenance_date date, maintenance_type string, "
                        f"description string, downtime_hours decimal(5,1), cost decimal(10,2), technician string, "
                        f"created_at {TS}",
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(RAW_DDL[table])


def read_raw(spark: SparkSession, base_dir: str, table: str, fmt: str = "parquet") -> DataFrame:
    """SRC01: read a raw table with its declared schema (no inference; extra file columns
    are ignored, missing ones read as NULL)."""
    return spark.read.schema(schema(table)).format(fmt).load(f"{base_dir.rstrip('/')}/{table}")
