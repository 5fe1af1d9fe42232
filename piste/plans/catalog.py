"""Registered queries over the driver tables.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame computed over the whole
tables (no sampling, no caps; a limit appears only where top-k is the feature).
Double columns are rounded to 4 places so results compare stably across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from piste.functions.core import fround, packed, round_doubles
from piste.plans import views as V
from piste.plans.semantic import query
from piste.plans.loads import CheckedLoads, MartLoads
from piste.plans.star import Star

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}


def register(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


_STARS: dict[tuple[int, str], Star] = {}


def star_for(spark: SparkSession, sf_dir: str) -> Star:
    """One lazily-built star per (session, input dir): plans and size checks are reused."""
    key = (id(spark), sf_dir)
    if key not in _STARS or _STARS[key].spark is not spark:
        _STARS[key] = Star(spark, sf_dir)
    return _STARS[key]


def _sem(view, metrics, dims, **kw) -> QueryFn:
    def run(spark, sf_dir):
        return round_doubles(query(view, star_for(spark, sf_dir), metrics, dims, **kw))
    return run


def _all(view):
    return [m.name for m in view.metrics]


# -- semantic views (V02-V07) ---------------------------------------------------------
REGISTRY["sem_revenue_by_season_segment"] = _sem(
    V.REVENUE, ["TICKET_REVENUE", "RENTAL_REVENUE", "FNB_REVENUE", "TOTAL_REVENUE"], ["SKI_SEASON", "CUSTOMER_SEGMENT"])
REGISTRY["sem_revenue_by_location_type"] = _sem(V.REVENUE, _all(V.REVENUE), ["LOCATION_TYPE"])
REGISTRY["sem_revenue_by_ticket_category"] = _sem(
    V.REVENUE, ["TICKET_REVENUE", "TICKETS_SOLD", "ADVANCE_SALES_SHARE_PCT", "ONLINE_CHANNEL_REVENUE",
                "ONLINE_CHANNEL_SHARE_PCT", "AVERAGE_TICKET_PRICE"], ["TICKET_CATEGORY", "MONTH_NAME"])
REGISTRY["sem_revenue_by_product_category"] = _sem(
    V.REVENUE, ["RENTAL_REVENUE", "RENTAL_TRANSACTIONS", "RENTAL_MARKUP_DOLLARS", "FNB_REVENUE", "FNB_TRANSACTIONS",
                "FNB_UPSELL_REVENUE"], ["PRODUCT_CATEGORY"])
REGISTRY["sem_customer_behavior_by_segment_age"] = _sem(
    V.CUSTOMER_BEHAVIOR, _all(V.CUSTOMER_BEHAVIOR), ["CUSTOMER_SEGMENT", "AGE_GROUP"])
REGISTRY["sem_daily_summary_by_season_month"] = _sem(
    V.DAILY_SUMMARY, _all(V.DAILY_SUMMARY), ["SKI_SEASON", "MONTH_NAME"])
REGISTRY["sem_operations_by_lift_type"] = _sem(
    V.OPERATIONS, _all(V.OPERATIONS), ["LIFT_TYPE", "TERRAIN_TYPE"])
REGISTRY["sem_passholder_by_season"] = _sem(V.PASSHOLDER, _all(V.PASSHOLDER), ["SKI_SEASON"])
REGISTRY["sem_revenue_totals"] = _sem(V.REVENUE, ["TICKET_REVENUE", "RENTAL_REVENUE", "FNB_REVENUE", "TOTAL_REVENUE"],
                                      [])


# -- named business queries (N01-N18) -------------------------------------------------
def _named(fn) -> QueryFn:
    def run(spark, sf_dir):
        return round_doubles(fn(star_for(spark, sf_dir)))
    return run


from piste.plans import named as N  # noqa: E402

for _name, _fn in (
    ("n01_avg_wait_by_lift_top5", N.n01_avg_wait_by_lift_top5),
    ("n04_segment_visit_profile", N.n04_segment_visit_profile),
    ("n05_visits_per_customer_by_segment", N.n05_visits_per_customer_by_segment),
    ("n06_revenue_by_category", N.n06_revenue_by_category),
    ("n07_visits_by_segment", N.n07_visits_by_segment),
    ("n08_season_by_pass_holder", N.n08_season_by_pass_holder),
    ("n08_top_states", N.n08_top_states),
    ("n08_age_mix", N.n08_age_mix),
    ("n09_yoy_by_week_of_season", N.n09_yoy_by_week_of_season),
    ("n10_weekend_vs_weekday_waits", N.n10_weekend_vs_weekday_waits),
    ("n10_hourly_profile", N.n10_hourly_profile),
    ("n14_revenue_per_visitor", N.n14_revenue_per_visitor),
    ("n18_unknown_entity", N.n18_unknown_entity),
):
    REGISTRY[_name] = _named(_fn)


# -- data-quality suite (Q01-Q07) ------------------------------------------------------
from piste.operators import quality as Q  # noqa: E402

STAR_CHECKS = [
    Q.Check("unique_fact_lift_scans_scan_key", "unique", "fact_lift_scans", "scan_key"),
    Q.Check("unique_fact_ticket_sales_sale_key", "unique", "fact_ticket_sales", "sale_key"),
    Q.Check("unique_fact_pass_usage_usage_key", "unique", "fact_pass_usage", "usage_key"),
    Q.Check("unique_dim_customer_customer_key", "unique", "dim_customer", "customer_key"),
    Q.Check("unique_dim_date_date_key", "unique", "dim_date", "date_key"),
    Q.Check("not_null_fact_ticket_sales_customer_key", "not_null", "fact_ticket_sales", "customer_key"),
    Q.Check("not_null_fact_ticket_sales_ticket_category", "not_null", "fact_ticket_sales", "ticket_category"),
    Q.Check("not_null_fact_lift_scans_wait_time_minutes", "not_null", "fact_lift_scans", "wait_time_minutes"),
    Q.Check("accepted_values_fact_ticket_sales_purchase_channel", "accepted_values", "fact_ticket_sales",
            "purchase_channel", values=("online", "window", "kiosk")),
    Q.Check("accepted_values_dim_customer_age_group", "accepted_values", "dim_customer", "age_group",
            values=("Child", "Young Adult", "Adult", "Senior")),
    Q.Check("relationships_fact_ticket_sales_customer_key", "relationships", "fact_ticket_sales", "customer_key",
            "dim_customer", "customer_key"),
    Q.Check("relationships_fact_ticket_sales_purchase_date_key", "relationships", "fact_ticket_sales",
            "purchase_date_key", "dim_date", "date_key"),
    Q.Check("relationships_fact_lift_scans_lift_key", "relationships", "fact_lift_scans", "lift_key", "dim_lift",
            "lift_key"),
    Q.Check("relationships_fact_rentals_product_key", "relationships", "fact_rentals", "product_key", "dim_product",
            "product_key"),
]


def _quality_suite(spark, sf_dir):
    return Q.run_suite(star_for(spark, sf_dir), STAR_CHECKS)


def _overlap(spark, sf_dir):
    st = star_for(spark, sf_dir)
    return Q.overlap_profile(st["fact_pass_usage"], "visit_date", st["dim_date"], "full_date")


# Every declared test of the star's dimensions and facts; two facts also get a check that real data
# breaks (one sales channel only, one visit a day), so that stored failures are not always empty.
from piste.plans.declared_tests import declared  # noqa: E402

MART_CHECKS = [c for c in declared() if c.table.startswith(("dim_", "fact_"))]
PROBE_CHECKS = [c for c in MART_CHECKS if c.kind == "relationships"] + [
    Q.Check("accepted_values_fact_ticket_sales_online_only", "accepted_values", "fact_ticket_sales", "purchase_channel", values=("online",)),
    Q.Check("unique_fact_pass_usage_date_key", "unique", "fact_pass_usage", "date_key"),
]


def _declared_suite(spark, sf_dir):
    return Q.run_suite(CheckedLoads(star_for(spark, sf_dir), MART_CHECKS), MART_CHECKS)


def _stored_failures(spark, sf_dir):
    """Q05: failing values written as a table in the shared folder and read back."""
    path = f"{checkpoint_root(spark)}/piste-failures-{uuid.uuid4().hex}"
    Q.store_failures(Q.failing_rows(star_for(spark, sf_dir), PROBE_CHECKS), path)
    return spark.read.parquet(path)


def _all_declared(spark, sf_dir):
    """Q06: every declared check, of staging tables, dimensions and facts, in one pass."""
    checks = declared()
    return Q.run_suite(CheckedLoads(star_for(spark, sf_dir), checks), checks)


REGISTRY["q05_stored_failures"] = _stored_failures
REGISTRY["q06_declared_tests"] = _all_declared
REGISTRY["q06_declared_mart_tests"] = _declared_suite
REGISTRY["q06_star_quality_suite"] = _quality_suite
REGISTRY["q07_visits_calendar_overlap"] = _overlap


# -- incremental load (I01-I06) and SCD-2 (D07) ------------------------------------------
import uuid  # noqa: E402

from piste.operators import dims as DM  # noqa: E402
from piste.operators import facts as FT  # noqa: E402
from piste.operators.incremental import incremental_load, upsert  # noqa: E402
from piste.session import checkpoint_root, staged  # noqa: E402
from piste.sources import adapters as AD  # noqa: E402

INCREMENT_CUTOFF = "1998-01-01"   # first load: sales before this date; second load: the rest


TICKET_LOAD = dict(unique_key="sale_key", watermark_col="purchase_timestamp", partition_col="purchase_month",
                   cluster_col="purchase_date_key")


def _ticket_loads(spark, sf_dir, second):
    """Sales before the cut-off loaded into a partitioned target, then ``second(build, staged sales,
    target)``; whatever the way, the result must equal a full build of the fact."""
    st = star_for(spark, sf_dir)
    target = f"{checkpoint_root(spark)}/piste-incremental-{uuid.uuid4().hex}/fact_ticket_sales"

    def build(stg, months=0):
        f = FT.fact_ticket_sales(stg, st["dim_customer"], st["dim_ticket_type"])
        return f.withColumn("purchase_month", F.date_format(F.add_months("purchase_date", months), "yyyy-MM"))

    stg = st["stg_ticket_sales"]
    history = stg.filter(F.col("purchase_date") < F.lit(INCREMENT_CUTOFF).cast("date"))
    second(build, history, stg, target)
    out = spark.read.parquet(target)
    return out.select("sale_key", "purchase_date_key", "customer_key", "ticket_type_key",
                      F.col("purchase_amount").cast("double").alias("purchase_amount"), "ticket_category")


def _loads(**options):
    """The history, then everything, both by ``incremental_load`` with these options for the second."""
    def query(spark, sf_dir):
        def second(build, history, stg, target):
            incremental_load(spark, build, history, target, **TICKET_LOAD)
            incremental_load(spark, build, stg, target, **TICKET_LOAD, **options)
        return _ticket_loads(spark, sf_dir, second)
    return query


def moved_keys(spark, sf_dir):
    """Every sale first stands one month early, so each key of the upsert changes partition and
    the first partitions end empty."""
    def second(build, history, stg, target):
        incremental_load(spark, lambda s: build(s, -1), history, target, **TICKET_LOAD)
        upsert(spark, build(stg), target, TICKET_LOAD["unique_key"], TICKET_LOAD["watermark_col"],
               TICKET_LOAD["partition_col"], TICKET_LOAD["cluster_col"])
    return _ticket_loads(spark, sf_dir, second)


def schema_change(mode):
    """The history is loaded without the sales channel and with the amount, the rest the
    other way round; ``mode`` decides which of the two columns the target has in the end."""
    def run(spark, sf_dir):
        st = star_for(spark, sf_dir)
        target = f"{checkpoint_root(spark)}/piste-schema-{uuid.uuid4().hex}/sales"
        early = F.col("purchase_date") < F.lit(INCREMENT_CUTOFF).cast("date")
        sales = st["stg_ticket_sales"].select("sale_id", "purchase_date", "purchase_timestamp", "purchase_amount", "purchase_channel")
        load = dict(unique_key="sale_id", watermark_col="purchase_timestamp", on_schema_change=mode)
        incremental_load(spark, lambda s: s.drop("purchase_channel"), sales.filter(early), target, **load)
        incremental_load(spark, lambda s: s.drop("purchase_amount"), sales, target, **load)
        loaded = spark.read.parquet(target)
        present = ",".join(sorted(loaded.columns))
        values = [F.count(c).alias(f"n_{c}") if c in loaded.columns else F.lit(0).cast("bigint").alias(f"n_{c}") for c in ("purchase_amount", "purchase_channel")]
        return loaded.groupBy(F.year("purchase_date").alias("year")).agg(F.count(F.lit(1)).alias("sales"), *values).withColumn("columns", F.lit(present))
    return run


SCD_CHANGE_TS = "2021-11-01 00:00:00"


def scd2_customer_snapshot(spark, sf_dir):
    """Merge a later customer snapshot (pass-holder threshold lowered) into the
    customer dimension: changed customers get a closed and a new open version."""
    st = star_for(spark, sf_dir)
    current = st["dim_customer"].select("customer_key", "customer_id", "customer_segment", "is_pass_holder",
                                        "state", "valid_from", "valid_to", "is_current")
    cust = AD.customers(st.t)
    acct = st.t.customer.select(F.col("c_custkey").alias("customer_id"), "c_acctbal")
    incoming = cust.join(acct, "customer_id").select(
        "customer_id", "customer_segment", (F.col("c_acctbal") > 4000).alias("is_pass_holder"), "state")
    merged = DM.scd2_merge(current, incoming, "customer_id", ["customer_segment", "is_pass_holder", "state"],
                           SCD_CHANGE_TS, key_name="customer_key")
    return merged


REGISTRY["i02_filter_after_build"] = _loads(filter_before_build=False)
REGISTRY["i03_incremental_ticket_sales"] = _loads()
REGISTRY["i03_upsert_moved_keys"] = moved_keys
REGISTRY["i04_full_refresh"] = _loads(full_refresh=True)
REGISTRY["i05_schema_change_append"] = schema_change("append_new_columns")
REGISTRY["i05_schema_change_sync"] = schema_change("sync_all_columns")
REGISTRY["d07_scd2_customer_snapshot"] = scd2_customer_snapshot


# -- Structured Streaming (T01-T04) ---------------------------------------------------------
from piste.operators import staging as STG  # noqa: E402
from piste.sources.driver import DriverTables  # noqa: E402
from piste.streaming import facts as SF  # noqa: E402


def _stream_root(spark) -> str:
    return f"{checkpoint_root(spark)}/piste-stream-{uuid.uuid4().hex}"


def stream_hourly_event_load(spark, sf_dir):
    """T02+T03: events as a file stream, deduplicated on event_id within the watermark,
    aggregated into tumbling hours per event type, upserted by (window, type)."""
    root = _stream_root(spark)
    s = SF.table_stream(spark, sf_dir, "events")
    s = SF.dedup_within_watermark(s, "ts", ["event_id"], "2 hours")
    agg = SF.hourly_load(s, "ts", "event_type", "value", None)
    q = (agg.writeStream.outputMode("update")
         .foreachBatch(SF.upsert_batch(f"{root}/out", ["window_start", "event_type"]))
         .option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out").select("window_start", "event_type", "events", "value_sum")


def stream_fact_lift_scans(spark, sf_dir):
    """T01+T04: lineitem as a file stream -> lift-scan staging, enriched stream-static
    with the current customer dimension -> fact rows upserted on scan_key."""
    st = star_for(spark, sf_dir)
    root = _stream_root(spark)
    stream = SF.table_stream(spark, sf_dir, "lineitem")
    orders = st.t.orders.select("o_orderkey", "o_custkey")

    def build(li):
        raw = AD.lift_scans_from_lines(li.join(orders, li.l_orderkey == orders.o_orderkey, "inner"))
        stg = STG.stg_lift_scans(raw)
        e = SF.enrich_with_current(stg, st["dim_customer"], "customer_id", ["customer_key"])
        return e.select(FT.surrogate_key(F.col("scan_id")).alias("scan_key"), "customer_key",
                        FT.surrogate_key(F.col("lift_id")).alias("lift_key"), "scan_date", "wait_time_minutes",
                        F.date_format("scan_date", "yyyy-MM").alias("scan_month"))

    # month-partitioned target: each micro-batch rewrites only the months it touches
    q = SF.stream_fact(stream, build, f"{root}/fact", ["scan_key"], f"{root}/ckpt", partition_col="scan_month")
    q.awaitTermination()
    f = spark.read.parquet(f"{root}/fact")
    return f.groupBy(FT.date_key("scan_date").alias("date_key")).agg(
        F.count(F.lit(1)).alias("scans"), F.countDistinct(packed("customer_key")).alias("riders"),
        F.sum("wait_time_minutes").alias("wait_sum"))


EVENT_PARTS = 4


def stream_late_events(spark, sf_dir):
    """T02+T03 with late rows: the events stand in part files of equal spans of time, the newest file
    first, and the stream takes one file per micro-batch, so all but the first batch come late."""
    events = DriverTables(spark, sf_dir).events
    span = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    step = (F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))) / EVENT_PARTS
    start, step = span.select(F.unix_micros(F.col("a").cast("timestamp")), step).first()
    root = _stream_root(spark)
    part = F.least(F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - start) / (step or 1)), F.lit(EVENT_PARTS - 1))
    for k in reversed(range(EVENT_PARTS)):
        events.where(part == k).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = SF.file_stream(spark, f"{root}/in", events.schema, max_files_per_trigger=1)
    q = (stream.writeStream.foreachBatch(SF.merge_hours(f"{root}/hours", "ts", "event_id", "event_type", "value", "2 hours"))
         .option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    return round_doubles(SF.merged_hours(spark, f"{root}/hours", "event_type"))


REGISTRY["t03_stream_hourly_event_load"] = stream_hourly_event_load
REGISTRY["t03_stream_late_events"] = stream_late_events
REGISTRY["t01_stream_fact_lift_scans"] = stream_fact_lift_scans


# -- single-fact views over the operations tables --------------------------------------------
REGISTRY["sem_weather_by_zone_season"] = _sem(V.WEATHER, _all(V.WEATHER), ["MOUNTAIN_ZONE", "SKI_SEASON"])
REGISTRY["sem_staffing_by_department_location"] = _sem(V.STAFFING, _all(V.STAFFING), ["DEPARTMENT", "LOCATION_NAME"])
REGISTRY["sem_satisfaction_by_category_sentiment"] = _sem(
    V.CUSTOMER_SATISFACTION, _all(V.CUSTOMER_SATISFACTION), ["CATEGORY", "SENTIMENT"])
REGISTRY["sem_safety_by_type_severity"] = _sem(V.SAFETY, _all(V.SAFETY), ["INCIDENT_TYPE", "SEVERITY"])
REGISTRY["sem_lessons_by_type_sport"] = _sem(V.LESSONS, _all(V.LESSONS), ["LESSON_TYPE", "SPORT_TYPE"])
for _name, _fn in (
    ("n02_coverage_by_department", N.n02_coverage_by_department),
    ("n03_powder_days", N.n03_powder_days),
    ("n11_weather_vs_attendance", N.n11_weather_vs_attendance),
    ("n12_snowfall_vs_revenue", N.n12_snowfall_vs_revenue),
    ("n13_monthly_trends", N.n13_monthly_trends),
):
    REGISTRY[_name] = _named(_fn)


# -- parking, grooming, employees (F13, ST12-ST14, ST18) --------------------------------------
def parking_by_status(spark, sf_dir):
    f = star_for(spark, sf_dir)["fact_parking"]
    return f.groupBy("lot_type", "occupancy_status").agg(
        F.count(F.lit(1)).alias("records"), F.sum("vehicles_entered").alias("entered"), F.sum("revenue_collected").cast("double").alias("revenue"),
        F.max("lot_capacity").alias("largest_lot"), F.sum(F.col("overflow_active").cast("int")).alias("overflows"))


def parking_by_tier(spark, sf_dir):
    p = star_for(spark, sf_dir)["stg_parking_occupancy"]
    return p.groupBy("record_hour", "occupancy_tier").agg(F.count(F.lit(1)).alias("records"), F.sum("available_spaces").alias("available"))


def grooming_by_shift(spark, sf_dir):
    g = star_for(spark, sf_dir)["stg_grooming_logs"]
    return g.groupBy("shift", F.year("grooming_date").alias("year")).agg(
        F.count(F.lit(1)).alias("runs"), F.sum("duration_minutes").alias("minutes"), F.sum(F.col("condition_improved").cast("int")).alias("improved"),
        F.avg("snow_depth_inches").alias("mean_depth"))


def staff_by_department(spark, sf_dir):
    e = star_for(spark, sf_dir)["stg_employees"]
    return e.groupBy("department", "job_title").agg(
        F.count(F.lit(1)).alias("employees"), F.avg(F.col("hourly_rate").cast("double")).alias("mean_rate"),
        F.count("reports_to").alias("with_supervisor"), F.sum(F.col("is_supervisor").cast("int")).alias("supervisors"))


REGISTRY["f13_parking_by_status"] = lambda spark, sf_dir: round_doubles(parking_by_status(spark, sf_dir))
REGISTRY["st13_parking_by_tier"] = parking_by_tier
REGISTRY["st12_grooming_by_shift"] = lambda spark, sf_dir: round_doubles(grooming_by_shift(spark, sf_dir))
REGISTRY["st18_staff_by_department"] = lambda spark, sf_dir: round_doubles(staff_by_department(spark, sf_dir))


# -- forecasting features and evaluation (P01-P24) --------------------------------------------
from piste.operators import features as FE  # noqa: E402
from piste.operators import forecast as FC  # noqa: E402

# the reference's visitor model configuration (groups, lags, windows), as a config dict
VISITOR_MODEL = {
    "target_column": "UNIQUE_VISITORS",
    "include": ["date_features", "weather_features", "cyclical_features", "day_dummies"],
    "exclude": [],
    "override": {},
    "lag_features": {"source": "UNIQUE_VISITORS", "lags": [7, 14, 21, 28]},
    "rolling_features": {"source": "UNIQUE_VISITORS", "windows": [7, 14, 30], "aggregation": "mean"},
}
SEGMENT = "CUSTOMER_SEGMENT"


def segment_training_frame(spark, sf_dir):
    st = star_for(spark, sf_dir)
    return FC.training_frame(st["dim_date"], st["fact_pass_usage"], st["fact_weather"],
                             entity=(SEGMENT, st["dim_customer"], "customer_key"))


def engineered_panel(spark, sf_dir):
    """Configured features, per-segment lags and (non-leaking) rolling means."""
    cfg = FE.build_config(VISITOR_MODEL)
    e = FE.engineer(segment_training_frame(spark, sf_dir), cfg, "FULL_DATE", entity=SEGMENT)
    return e.select(SEGMENT, "FULL_DATE", "UNIQUE_VISITORS", "day_of_week", "month", "is_weekend", "is_holiday",
                    "snow_condition_encoded", "day_sin", "day_0", "day_6", "lag_7", "lag_14", "lag_21", "lag_28",
                    "rolling_7_mean", "rolling_14_mean", "rolling_30_mean")


def time_split_counts(spark, sf_dir):
    s = FE.time_split(segment_training_frame(spark, sf_dir), "FULL_DATE", SEGMENT)
    return s.groupBy(SEGMENT).agg(F.count(F.when(F.col("is_train"), 1)).alias("train_rows"),
                                  F.count(F.when(~F.col("is_train"), 1)).alias("test_rows"),
                                  F.max(F.when(F.col("is_train"), F.col("FULL_DATE"))).alias("train_end"))


def weekday_means_january(spark, sf_dir):
    return FC.weekday_means(segment_training_frame(spark, sf_dir), "FULL_DATE", "UNIQUE_VISITORS", 1, SEGMENT)


def weekday_means_by_month(spark, sf_dir):
    return FC.weekday_means_by_month(segment_training_frame(spark, sf_dir), "FULL_DATE", "UNIQUE_VISITORS", SEGMENT)


def weather_normals_by_month(spark, sf_dir):
    st = star_for(spark, sf_dir)
    return FC.weather_normals_by_month(st["fact_weather"], st["dim_date"])


def weather_normals_january(spark, sf_dir):
    st = star_for(spark, sf_dir)
    return FC.weather_normals(st["fact_weather"], st["dim_date"], 1)


def weekday_weekend_profile(spark, sf_dir):
    return FC.weekday_weekend_profile(segment_training_frame(spark, sf_dir), "UNIQUE_VISITORS", "IS_WEEKEND", SEGMENT)


_MODELS: dict = {}


def _fit(spark, sf_dir):
    """Train once per (session, input): the metrics and the forecast share one model."""
    key = (id(spark), sf_dir)
    if key not in _MODELS or _MODELS[key][0] is not spark:
        _MODELS[key] = (spark, _train(spark, sf_dir))
    return _MODELS[key][1]


def _train(spark, sf_dir):
    """The panel, written once; a model validated on the last tenth of each segment's training rows
    (72%-80% of the series), and the one refitted on all rows with its best iteration."""
    cfg = FE.build_config(VISITOR_MODEL)
    e = FE.engineer(segment_training_frame(spark, sf_dir), cfg, "FULL_DATE", entity=SEGMENT)
    e = FE.time_split(e, "FULL_DATE", SEGMENT)
    feats = FE.feature_columns(e, cfg)
    e = FE.time_split(e.withColumnRenamed("is_train", "__tr"), "FULL_DATE", SEGMENT, 0.72)
    e = e.withColumn("is_valid", F.col("__tr") & ~F.col("is_train")).withColumn("is_train", F.col("__tr")).drop("__tr")
    # one order whatever the cluster: row sampling of the trees then repeats
    e = staged(e.repartition(8, SEGMENT).sortWithinPartitions(SEGMENT, "FULL_DATE"), "panel")
    validated = FC.train_gbt(e.filter("is_train"), feats, "UNIQUE_VISITORS", validation_col="is_valid")
    return {"validated": validated, "final": FC.refit_all(e, validated, feats, "UNIQUE_VISITORS"), "panel": e, "features": feats, "config": cfg}


def gbt_forecast_metrics(spark, sf_dir):
    """GBT on the segment panel; MAE/RMSE/MAPE/R2 per split and the gate."""
    fit = _fit(spark, sf_dir)
    pred = fit["validated"].transform(fit["panel"]).withColumn("split", F.when(F.col("is_train"), "train").otherwise("test"))
    return FC.quality_gate(FC.regression_metrics(pred, "UNIQUE_VISITORS", group=["split"]))


def refit_report(spark, sf_dir):
    """Both fits with their trees and rows: the validation run's best iteration is the number of
    trees of the model fitted to all rows."""
    fit = _fit(spark, sf_dir)
    n = fit["panel"].agg(F.count(F.when(F.col("is_train") & ~F.col("is_valid"), 1)).alias("fitted"), F.count(F.when(F.col("is_valid"), 1)).alias("valid"),
                         F.count(F.lit(1)).alias("every")).first()
    return spark.createDataFrame([("validation", FC.best_iteration(fit["validated"]), n["fitted"], n["valid"]),
                                  ("final", FC.best_iteration(fit["final"]), n["every"], 0)],
                                 "fit string, trees int, fitted_rows long, validation_rows long")


def _model_inputs(spark, sf_dir):
    """Forecast rows of the two weeks after the last training day, per segment, with every
    input of the model."""
    st, cfg = star_for(spark, sf_dir), FE.build_config(VISITOR_MODEL)
    hist = segment_training_frame(spark, sf_dir)
    last = hist.agg(F.max("FULL_DATE")).first()[0]
    start = (last + __import__("datetime").timedelta(days=1)).isoformat()
    fut = FC.future_frame(hist, "FULL_DATE", "UNIQUE_VISITORS", start, 14, entity=SEGMENT)
    # one-row normals attached to every forecast row as literals
    n = FC.weather_normals(st["fact_weather"], st["dim_date"], int(start[5:7])).first().asDict()
    fut = fut.select("*", *[F.lit(v).alias(k) for k, v in n.items()])
    calendar = st["dim_date"].select(F.col("full_date").alias("FULL_DATE"), F.col("is_holiday").cast("int").alias("IS_HOLIDAY"))
    needed = [f["name"] for f in cfg.features] + [f"lag_{k}" for k in cfg.lags] + [f"rolling_{w}_{cfg.aggregation}" for w in cfg.windows]
    made = FE.future_features(fut.join(calendar, "FULL_DATE", "left"), cfg, "FULL_DATE", needed)
    return made.select(SEGMENT, "FULL_DATE", *needed)


def _daily_forecast(spark, sf_dir):
    scored = _fit(spark, sf_dir)["final"].transform(_model_inputs(spark, sf_dir))
    return scored.withColumn("predicted_visitors", FC.clamp_prediction(F.col("prediction")))


def forecast_next_two_weeks(spark, sf_dir):
    """Future rows per segment with lag/rolling look-ups and weather normals,
    scored, clamped, banded, summarised."""
    summary = FC.forecast_summary(_daily_forecast(spark, sf_dir), "FULL_DATE", "predicted_visitors", SEGMENT)
    return summary.withColumn("peak_staffing_level", FC.staffing_band(F.col("peak_visitors")))


def daily_forecast_bands(spark, sf_dir):
    """Every forecast day with its staffing band."""
    daily = _daily_forecast(spark, sf_dir).select(SEGMENT, "FULL_DATE", "predicted_visitors")
    return FC.assign_bands(daily, "predicted_visitors", FC.default_bands(spark))


#: A band table of a small resort, as a site would configure it.
SITE_BANDS = [("closed", 0, 1, "0", "none"), ("quiet", 1, 4, "2", "1 location"), ("steady", 4, 10, "4", "2 locations"),
              ("busy", 10, 60, "8", "3 locations"), ("peak", 60, None, "12+", "all locations")]


def daily_staffing_bands(spark, sf_dir):
    """The visitors of every calendar day in the site's bands, counted by season and band."""
    st = star_for(spark, sf_dir)
    bands = spark.createDataFrame(SITE_BANDS, "level string, min_visitors long, max_visitors long, lift_operators string, f_and_b string")
    visits = st.narrow("fact_pass_usage", ["date_key", "customer_id"]).groupBy("date_key").agg(F.countDistinct("customer_id").alias("visitors"))
    days = st["dim_date"].select("date_key", "ski_season").join(visits, "date_key", "left").withColumn("visitors", F.coalesce("visitors", F.lit(0)))
    banded = FC.assign_bands(days, "visitors", bands)
    return banded.groupBy("ski_season", "level", "lift_operators").agg(F.count(F.lit(1)).alias("days"), F.max("visitors").alias("most_visitors"))


REGISTRY["p01_training_frame_by_segment"] = lambda spark, sf_dir: round_doubles(segment_training_frame(spark, sf_dir))
REGISTRY["p11_engineered_panel"] = lambda spark, sf_dir: round_doubles(engineered_panel(spark, sf_dir))
REGISTRY["p13_time_split_counts"] = time_split_counts
REGISTRY["p19_weekday_means_january"] = lambda spark, sf_dir: round_doubles(weekday_means_january(spark, sf_dir))
REGISTRY["p20_weather_normals_january"] = lambda spark, sf_dir: round_doubles(weather_normals_january(spark, sf_dir))
REGISTRY["p19_weekday_means_by_month"] = lambda spark, sf_dir: round_doubles(weekday_means_by_month(spark, sf_dir))
REGISTRY["p20_weather_normals_by_month"] = lambda spark, sf_dir: round_doubles(weather_normals_by_month(spark, sf_dir))
REGISTRY["p24_weekday_weekend_profile"] = lambda spark, sf_dir: round_doubles(weekday_weekend_profile(spark, sf_dir))
def gbt_feature_importance(spark, sf_dir):
    """Top-10 features of the fitted model (model metadata, not data, on the driver)."""
    fit = _fit(spark, sf_dir)
    top = FC.feature_importance(fit["validated"], fit["features"], 10)
    return spark.createDataFrame([(i + 1, f, float(round(v, 6))) for i, (f, v) in enumerate(top)],
                                 "rank int, feature string, importance double")


REGISTRY["p14_gbt_forecast_metrics"] = gbt_forecast_metrics
REGISTRY["p14_refit_on_all_rows"] = refit_report
REGISTRY["p18_model_inputs"] = lambda spark, sf_dir: round_doubles(_model_inputs(spark, sf_dir))
REGISTRY["p22_daily_staffing_bands"] = daily_staffing_bands
REGISTRY["p23_daily_forecast_bands"] = daily_forecast_bands
REGISTRY["p17_gbt_feature_importance"] = gbt_feature_importance
REGISTRY["p23_forecast_next_two_weeks"] = forecast_next_two_weeks


# -- monitoring and drift (O01-O10) -----------------------------------------------------------
from piste.operators import monitoring as MO  # noqa: E402

MONITOR_AS_OF_LAG_DAYS = 3   # the last 3 days of the log have no actuals yet


_LOGS: dict = {}


def prediction_log(spark, sf_dir):
    """Naive seasonal (lag-7) predictions for every segment-day, backfilled with actuals
    up to ``as_of``: a deterministic prediction log derived from the star.  It is written once per
    (session, input) and read by every monitoring query."""
    key = (id(spark), sf_dir)
    if key not in _LOGS or _LOGS[key][0] is not spark:
        _LOGS[key] = (spark, *_written_log(spark, sf_dir))
    return spark.read.parquet(_LOGS[key][1]).select(*MO.LOG_COLUMNS), _LOGS[key][2]


def _written_log(spark, sf_dir):
    panel = staged(engineered_panel(spark, sf_dir), "panel")
    d = F.col("FULL_DATE")
    log = MO.log_from_predictions(
        panel.withColumn("naive", F.col("lag_7")), SEGMENT, "FULL_DATE", "naive", "VISITOR_FORECASTER",
        F.when(F.year(d) % 2 == 0, "v1").otherwise("v2"), F.concat(F.lit("run-"), F.date_format(d, "yyyyMM")))
    as_of, path = monitor_as_of(panel), f"{checkpoint_root(spark)}/piste-log-{uuid.uuid4().hex}/predictions"
    MO.append_predictions(log, path)
    actuals = panel.select(F.col(SEGMENT).alias("series"), F.col("FULL_DATE").alias("forecast_date"), F.col("UNIQUE_VISITORS").alias("actual"))
    MO.backfill_log(spark, path, actuals, as_of)
    return path, as_of


def monitor_as_of(panel) -> str:
    last = panel.agg(F.max("FULL_DATE")).first()[0]
    return (last - __import__("datetime").timedelta(days=MONITOR_AS_OF_LAG_DAYS)).isoformat()


def _mon(fn):
    def run(spark, sf_dir):
        log, as_of = prediction_log(spark, sf_dir)
        return round_doubles(fn(log, as_of))
    return run


REGISTRY["o03_prediction_errors"] = _mon(lambda log, as_of: MO.with_errors(log).select(
    "series", "forecast_date", "model_version", "predicted_visitors", "actual_visitors", "error", "absolute_error",
    "percentage_error"))
REGISTRY["o05_daily_performance"] = _mon(lambda log, as_of: MO.daily_performance(log))
REGISTRY["o06_recent_performance"] = _mon(lambda log, as_of: MO.recent_performance(log, as_of))
REGISTRY["o07_feature_drift"] = _mon(lambda log, as_of: MO.feature_drift(log, as_of))
REGISTRY["o08_metrics_by_version"] = _mon(lambda log, as_of: MO.metrics_by_version(log))
REGISTRY["o09_retrain_decision"] = _mon(lambda log, as_of: MO.retrain_decision(log))
REGISTRY["o10_bias_check"] = _mon(lambda log, as_of: MO.bias_check(log))


# -- text and page mining (X01-X08) --------------------------------------------------------------
from piste.operators import text as TX  # noqa: E402


def page_extraction(spark, sf_dir):
    p = TX.extract_pages(DriverTables(spark, sf_dir).pages)
    return p.select("page_id", "url", "url_valid", "title", "content", "content_chars",
                    F.array_join("prices", "|").alias("prices"))


def document_inventory(spark, sf_dir):
    return TX.document_inventory(DriverTables(spark, sf_dir).documents, "lang", "source")


def conversation_key_points(spark, sf_dir):
    c = DriverTables(spark, sf_dir).conversations
    k = c.select("conv_id", "turn", F.posexplode(TX.key_points(F.col("text"))).alias("pos", "point"))
    return k.select("conv_id", "turn", (F.col("pos") + 1).alias("point_no"), "point")


def conversation_sections(spark, sf_dir):
    c = DriverTables(spark, sf_dir).conversations
    return TX.markdown_sections(c, ["conv_id", "turn"]).select("conv_id", "turn", "section_no", "title",
                                                               F.length("content").alias("content_chars"))


def conversation_tables(spark, sf_dir):
    """Every message with a table of its lines (number, characters, words) below it; the
    tables are found again in the text and their cells read as numbers."""
    lines = F.split("text", "\n")
    number = lambda c: F.format_number(c, 0)
    body = F.transform(lines, lambda x, i: F.concat(F.lit("| "), number(i + 1), F.lit(" | "), number(F.length(x)), F.lit(" | "),
                                                    number(F.size(TX.tokens(x))), F.lit(" |")))
    report = F.concat(F.col("text"), F.lit("\n\n| line | characters | words |\n|---|:---:|---:|\n"), F.array_join(body, "\n"), F.lit("\n\nEnd."))
    reports = DriverTables(spark, sf_dir).conversations.select("conv_id", "turn", report.alias("text"))
    rows = TX.markdown_tables(reports, ["conv_id", "turn"])
    values = [TX.parse_number(F.get("cells", F.lit(j))).cast("bigint").alias(c) for j, c in enumerate(("line", "characters", "words"))]
    return rows.select("conv_id", "turn", "table_no", (F.col("row_no") + 1).alias("row_no"), F.array_join("headers", "|").alias("headers"), *values)


def _keyword_search(match):
    def run(spark, sf_dir):
        t = DriverTables(spark, sf_dir)
        q = t.benchmark.select(F.col("item_id").alias("query_id"), "text")
        r = TX.keyword_search(t.documents, q, k=10, match=match)
        return r.withColumn("score", fround("score", 4))
    return run


REGISTRY["x01_page_extraction"] = page_extraction
REGISTRY["x05_document_inventory"] = document_inventory
REGISTRY["x06_conversation_key_points"] = conversation_key_points
REGISTRY["x07_conversation_sections"] = conversation_sections
REGISTRY["x07_conversation_tables"] = conversation_tables
REGISTRY["x04_benchmark_keyword_search"] = _keyword_search("any")
REGISTRY["x04_benchmark_keyword_search_all"] = _keyword_search("all")
REGISTRY["x04_vector_prototype_search"] = lambda spark, sf_dir: TX.vector_prototype_search(
    DriverTables(spark, sf_dir).embeddings, k=5)


# -- ingest bookkeeping (SRC06-SRC09) ---------------------------------------------------------------
from piste.sources import io as IO  # noqa: E402


def star_row_counts(spark, sf_dir):
    st = star_for(spark, sf_dir)
    return IO.row_counts({n: st[n] for n in ("dim_date", "dim_customer", "dim_lift", "dim_location", "dim_product",
                                              "dim_ticket_type", "fact_lift_scans", "fact_pass_usage",
                                              "fact_ticket_sales", "fact_rentals", "fact_food_beverage",
                                              "fact_weather", "fact_staffing", "fact_feedback", "fact_incidents",
                                              "fact_lessons")})


def star_freshness(spark, sf_dir):
    st = star_for(spark, sf_dir)
    return IO.freshness({"fact_lift_scans": (st["fact_lift_scans"], "scan_timestamp"),
                         "fact_pass_usage": (st["fact_pass_usage"], "visit_date"),
                         "fact_ticket_sales": (st["fact_ticket_sales"], "purchase_date"),
                         "fact_rentals": (st["fact_rentals"], "rental_date"),
                         "fact_food_beverage": (st["fact_food_beverage"], "transaction_date"),
                         "fact_weather": (st["fact_weather"], "weather_date")})


def idempotent_increment(spark, sf_dir):
    """SRC06: orders of dates not yet present in the loaded ticket sales (history before
    the increment cut-off counts as loaded)."""
    st = star_for(spark, sf_dir)
    loaded = st["stg_ticket_sales"].filter(F.col("purchase_date") < F.lit(INCREMENT_CUTOFF).cast("date"))
    new = IO.new_dates_only(st.t.orders, "o_orderdate", [loaded], ["purchase_date"])
    return new.groupBy(F.to_date("o_orderdate").alias("order_date")).agg(F.count(F.lit(1)).alias("orders"))


def order_sample(spark, sf_dir):
    return IO.sample_rows(DriverTables(spark, sf_dir).orders, 0.1).select("o_orderkey", "o_custkey")


REGISTRY["src07_star_row_counts"] = star_row_counts
REGISTRY["src08_star_freshness"] = star_freshness
REGISTRY["src06_idempotent_increment"] = idempotent_increment
REGISTRY["src09_order_sample"] = order_sample


# -- marketing and season passes ----------------------------------------------------------------
REGISTRY["sem_marketing_by_channel_season"] = _sem(V.MARKETING, _all(V.MARKETING), ["CAMPAIGN_CHANNEL", "SKI_SEASON"])
for _name, _fn in (
    ("n15_pass_renewal_rate", N.n15_pass_renewal_rate),
    ("n16_campaign_roi", N.n16_campaign_roi),
    ("n17_campaign_funnel", N.n17_campaign_funnel),
):
    REGISTRY[_name] = _named(_fn)


# Calendar-densified history and the simple training frame, at a fixed as-of
FORECAST_AS_OF = "2001-01-01"
REGISTRY["p03_simple_training_frame"] = lambda spark, sf_dir: FC.simple_training_frame(
    star_for(spark, sf_dir)["dim_date"], star_for(spark, sf_dir)["fact_pass_usage"], FORECAST_AS_OF, 3)
REGISTRY["p02_history_for_lags"] = lambda spark, sf_dir: FC.history_for_lags(
    star_for(spark, sf_dir)["dim_date"], star_for(spark, sf_dir)["fact_pass_usage"], FORECAST_AS_OF, 365)


# -- materialized marts ---------------------------------------------------------------------------
from piste.operators import sketches as SK  # noqa: E402
from piste.plans import marts as MT  # noqa: E402

REVENUE_MARTS = ["dim_date", "dim_customer", "dim_location", "dim_product", "dim_ticket_type", "fact_ticket_sales",
                 "fact_rentals", "fact_food_beverage"]


def revenue_from_marts(spark, sf_dir):
    """The flagship drill-across over written marts (facts month-partitioned, clustered on
    their date key) instead of in-line facts; results equal the in-line query."""
    root = f"{checkpoint_root(spark)}/piste-marts-{uuid.uuid4().hex}"
    MT.materialize(MartLoads(star_for(spark, sf_dir)), root, REVENUE_MARTS)
    marts = MT.Marts(spark, root, REVENUE_MARTS)
    return round_doubles(query(V.REVENUE, marts, ["TICKET_REVENUE", "RENTAL_REVENUE", "FNB_REVENUE", "TOTAL_REVENUE"],
                               ["SKI_SEASON", "CUSTOMER_SEGMENT"]))


REGISTRY["sem_revenue_from_marts"] = revenue_from_marts


def wait_percentiles_from_sketches(spark, sf_dir):
    """R14/M048: 95th percentile waits by lift type and by season, both merged from one written mart of
    daily sketches; a row says whether the estimate's true rank keeps to the sketch's bound."""
    st = star_for(spark, sf_dir)
    scans = staged(st.narrow("fact_lift_scans", ["date_key", "lift_key", "wait_time_minutes"]), "scans")  # read three times
    root = f"{checkpoint_root(spark)}/piste-marts-{uuid.uuid4().hex}"
    MT.materialize({"lift_wait_sketches": SK.sketched(scans, ["date_key", "lift_key"], "wait_time_minutes")}, root, ["lift_wait_sketches"])
    mart = MT.Marts(spark, root, ["lift_wait_sketches"])["lift_wait_sketches"]
    lifts, days = st["dim_lift"].select("lift_key", "lift_type"), st["dim_date"].select("date_key", "ski_season")
    out = None
    for by, dim, key in (("lift_type", lifts, "lift_key"), ("ski_season", days, "date_key")):
        asked = SK.merged(mart.join(dim, key, "left"), by).select(by, "values", SK.quantile("sketch", 0.95).alias("p95"))
        ok = SK.within_bound(scans.join(dim, key, "left"), [by], "wait_time_minutes", asked, "p95", 0.95, SK.rank_bound())
        part = asked.join(ok, asked[by].eqNullSafe(ok[by])).select(
            F.lit(by).alias("slice"), asked[by].alias("member"), F.col("values").alias("scans"), F.lit(SK.rank_bound()).alias("rank_bound"), "within")
        out = part if out is None else out.unionByName(part)
    return out


REGISTRY["r14_wait_percentiles_from_sketches"] = wait_percentiles_from_sketches


# -- R22 tail mean, R30 JSON feature blob (O01 log content) ----------------------------------------
REGISTRY["r22_tail_7_mean_by_segment"] = lambda spark, sf_dir: round_doubles(
    FE.tail_mean(segment_training_frame(spark, sf_dir), "FULL_DATE", "UNIQUE_VISITORS", 7, SEGMENT))


def prediction_log_features(spark, sf_dir):
    """The logged feature blob parsed back (JSON round trip of the drift features)."""
    log, _ = prediction_log(spark, sf_dir)
    blob = F.from_json("features_json", "lag_7 double, lag_14 double, rolling_7_mean double")
    return round_doubles(log.select("series", "forecast_date", "run_id", "model_version",
                                    blob["lag_7"].alias("lag_7"), blob["lag_14"].alias("lag_14"),
                                    blob["rolling_7_mean"].alias("rolling_7_mean")))


REGISTRY["o01_prediction_log_features"] = prediction_log_features


def future_frame_inputs(spark, sf_dir):
    """P18-P20 inputs (deterministic part of the forecast): two weeks after the last
    training day per segment, with looked-up lags and rolling means and their fallbacks."""
    hist = segment_training_frame(spark, sf_dir)
    last = hist.agg(F.max("FULL_DATE")).first()[0]
    start = (last + __import__("datetime").timedelta(days=1)).isoformat()
    fut = FC.future_frame(hist, "FULL_DATE", "UNIQUE_VISITORS", start, 14, entity=SEGMENT)
    return round_doubles(fut.select(SEGMENT, "FULL_DATE", "lag_7", "lag_14", "lag_21", "lag_28", "rolling_7_mean",
                                    "rolling_14_mean", "rolling_30_mean", "day_of_week", "month", "is_weekend"))


REGISTRY["p18_future_frame_inputs"] = future_frame_inputs


# -- file sources and sinks, round trips through written files (SRC02-SRC05, SNK01-SNK04) ------------
def _files(spark, name) -> str:
    return f"{checkpoint_root(spark)}/piste-files-{uuid.uuid4().hex}/{name}"


def csv_round_trip(spark, sf_dir):
    """SNK04 + SRC02: orders exported as CSV and read back under their declared schema, strictly."""
    cols = ["o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice", "o_orderpriority"]
    orders = DriverTables(spark, sf_dir).orders.select(*cols).withColumn("o_orderdate", F.to_date("o_orderdate"))
    path = _files(spark, "orders.csv")
    IO.export_csv(orders, path)
    back = IO.read_csv_strict(spark, path, orders.schema)
    return round_doubles(back.groupBy("o_orderpriority", F.year("o_orderdate").alias("year")).agg(
        F.count(F.lit(1)).alias("orders"), F.count("o_orderstatus").alias("with_status"), F.max("o_totalprice").alias("largest"), F.max("o_orderkey").alias("last_key")))


def tolerant_csv(spark, sf_dir):
    """SNK03 + SRC03: lines exported as gzip CSV with an unreadable quantity in every seventh line of an
    order; the rest is loaded, the bad rows go to the reject path."""
    lines = DriverTables(spark, sf_dir).lineitem
    quantity = F.when(F.col("l_linenumber") == 7, "seven").otherwise(F.col("l_quantity").cast("string"))
    path, rejects = _files(spark, "lines.csv"), _files(spark, "rejects")
    IO.export_csv_gz(lines.select("l_orderkey", quantity.alias("l_quantity"), "l_returnflag"), path)
    schema = StructType.fromDDL("l_orderkey bigint, l_quantity double, l_returnflag string")
    good = IO.read_csv_tolerant(spark, path, schema, rejects)
    loaded = good.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))
    bad = spark.read.schema(schema).json(rejects).agg(F.count(F.lit(1)).alias("n"))
    return round_doubles(loaded.select(F.lit("loaded").alias("result"), "l_returnflag", "n", "quantity").unionByName(
        bad.select(F.lit("rejected").alias("result"), F.lit(None).cast("string").alias("l_returnflag"), "n", F.lit(None).cast("double").alias("quantity"))))


def seed_join(spark, sf_dir):
    """SRC04: the regions as a seed file, joined to the customers of their nations."""
    t = DriverTables(spark, sf_dir)
    path = _files(spark, "region.csv")
    IO.export_csv(t.region.select("r_regionkey", "r_name"), path)
    seed = IO.read_seed(spark, path, StructType.fromDDL("r_regionkey bigint, r_name string"))
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(seed, F.col("n_regionkey") == F.col("r_regionkey"))
    return c.groupBy("r_name").agg(F.count(F.lit(1)).alias("customers"))


def json_documents(spark, sf_dir):
    """SRC05 + SNK02: documents as JSON lines, loaded twice; loading replaces."""
    docs = DriverTables(spark, sf_dir).documents.select("doc_id", "text", "lang")
    path, target = _files(spark, "docs.json"), _files(spark, "documents")
    docs.write.json(path)
    for _ in range(2):
        IO.load_documents_json(spark, path, target, docs.schema, multi_line=False)
    return spark.read.parquet(target).groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length("text")).alias("chars"), F.max("doc_id").alias("last_id"))


def appended_days(spark, sf_dir):
    """SNK01: events appended in two loads (even and odd days), partitioned by day."""
    events, target = DriverTables(spark, sf_dir).events, _files(spark, "events")
    for parity in (0, 1):
        IO.append_day(events.where(F.dayofmonth("ts") % 2 == parity), target, "ts")
    return round_doubles(spark.read.parquet(target).groupBy(F.col("__day").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("events"), F.sum("value").alias("value_sum")))


from pyspark.sql.types import StructType  # noqa: E402

REGISTRY["src02_csv_round_trip"] = csv_round_trip
REGISTRY["src03_tolerant_csv"] = tolerant_csv
REGISTRY["src04_seed_join"] = seed_join
REGISTRY["src05_json_documents"] = json_documents
REGISTRY["snk01_appended_days"] = appended_days


# -- flat view access (V08), configured features (P10, P12), fixed predictions (P15, P16, P21, R23) ----
def flat_view(spark, sf_dir):
    """A view's row-level join as a temporary view that SQL asks."""
    from piste.plans.semantic import register_sql_view

    name = "flat_customer_behavior"
    register_sql_view(V.CUSTOMER_BEHAVIOR, star_for(spark, sf_dir), "FACT_PASS_USAGE", name, ["CUSTOMER_SEGMENT", "SKI_SEASON", "TOTAL_LIFT_RIDES", "IS_PASS_HOLDER"])
    return spark.sql(f"SELECT CUSTOMER_SEGMENT, SKI_SEASON, COUNT(*) AS visits, SUM(TOTAL_LIFT_RIDES) AS rides, COUNT_IF(IS_PASS_HOLDER) AS by_pass "
                     f"FROM {name} GROUP BY CUSTOMER_SEGMENT, SKI_SEASON")


CONFIGURED = {
    "include": ["date_features", "cyclical_features"], "exclude": ["is_holiday", "month_cos"], "override": {"day_sin": {"period": 14}},
    "custom": [{"name": "december", "type": "one_hot", "source": "month", "value": 12}, {"name": "day_of_month", "type": "date_extract", "extract": "day", "dtype": "int"}],
    "lag_features": {"source": "UNIQUE_VISITORS", "lags": [7]}, "rolling_features": {"source": "UNIQUE_VISITORS", "windows": [7], "aggregation": "mean"},
}
ENVIRONMENT = {"lag_features": {"lags": [1, 7]}, "rolling_features": {"windows": [3, 5], "aggregation": "sum"}}


def _configured(spark, sf_dir, env):
    cfg = FE.build_config(CONFIGURED, env)
    return FE.engineer(segment_training_frame(spark, sf_dir), cfg, "FULL_DATE", entity=SEGMENT).select(SEGMENT, "FULL_DATE", *[
        f["name"] for f in cfg.features], *[f"lag_{k}" for k in cfg.lags], *[f"rolling_{n}_{cfg.aggregation}" for n in cfg.windows])


def naive_metrics(spark, sf_dir):
    """Error measures and gate of the prediction "as a week ago", per segment."""
    return FC.quality_gate(FC.regression_metrics(engineered_panel(spark, sf_dir), "UNIQUE_VISITORS", "lag_7", [SEGMENT]))


def naive_summary(spark, sf_dir):
    """A tenth more than a week ago, less two, clamped; summarised per segment."""
    panel = engineered_panel(spark, sf_dir).withColumn("predicted", FC.clamp_prediction(F.col("lag_7") * 1.1 - 2))
    return FC.forecast_summary(panel, "FULL_DATE", "predicted", SEGMENT)


REGISTRY["v08_flat_view"] = flat_view
REGISTRY["p12_configured_panel"] = lambda spark, sf_dir: round_doubles(_configured(spark, sf_dir, ENVIRONMENT))
REGISTRY["p10_rolling_deviation"] = lambda spark, sf_dir: round_doubles(_configured(spark, sf_dir, {"rolling_features": {"windows": [5], "aggregation": "std"}}))
REGISTRY["p15_naive_metrics"] = lambda spark, sf_dir: round_doubles(naive_metrics(spark, sf_dir))
REGISTRY["p23_naive_summary"] = lambda spark, sf_dir: round_doubles(naive_summary(spark, sf_dir))


# -- alert bookkeeping (A01-A03) ------------------------------------------------------------------------
from piste.operators import alerts as AL  # noqa: E402

ALERT_DAY, ALERT_TIME = "2024-01-31", "2024-01-31 07:00:00"


def due_alerts(spark, sf_dir):
    """Subscriptions due on the day, by frequency."""
    due = AL.due_alerts(AD.alert_subscriptions(DriverTables(spark, sf_dir)), ALERT_DAY)
    return due.groupBy(F.lower(F.trim("frequency")).alias("frequency")).agg(
        F.count(F.lit(1)).alias("due"), F.count("last_sent_at").alias("sent_before"), F.sum(F.col("alert_id").cast("bigint")).alias("ids"))


def alert_run_log(spark, sf_dir):
    """The run's log, and the subscriptions that it moved on."""
    t = DriverTables(spark, sf_dir)
    log = AL.run_log(AD.alert_results(t), ALERT_TIME)
    moved = AL.mark_sent(AD.alert_subscriptions(t), log).where(F.col("last_sent_at") == F.lit(ALERT_TIME).cast("timestamp_ntz"))
    counts = log.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count("response").alias("responses"), F.count("error_message").alias("errors"))
    return counts.unionByName(moved.agg(F.count(F.lit(1)).alias("n")).select(F.lit("moved on").alias("status"), "n", *[F.lit(None).cast("bigint").alias(c) for c in ("responses", "errors")]))


def alert_listing(spark, sf_dir):
    """Subscriptions of every recipient with their sends, after one recipient cancelled by a part of
    the question."""
    t = DriverTables(spark, sf_dir)
    alerts = AL.cancel_matching(AD.alert_subscriptions(t), "user7@example.org", "MACHINERY")
    listed = AL.subscriptions(alerts, AL.run_log(AD.alert_results(t), ALERT_TIME))
    return listed.groupBy("recipient_email").agg(F.count(F.lit(1)).alias("alerts"), F.sum("times_sent").alias("times_sent"), F.sum(F.col("is_active").cast("int")).alias("active"))


REGISTRY["a01_due_alerts"] = due_alerts
REGISTRY["a02_alert_run_log"] = alert_run_log
REGISTRY["a03_alert_listing"] = alert_listing


# -- evaluation roll-ups (E01-E04) -----------------------------------------------------------------------
from piste.operators import evaluation as EV  # noqa: E402


def evaluation_scores(spark, sf_dir):
    """Goal, plan and action scores of every question, by agent."""
    return round_doubles(EV.rollup(EV.score_results(AD.evaluation_results(DriverTables(spark, sf_dir)).repartition("question_id")), "agent_name"))


def golden_versions(spark, sf_dir):
    """The second version of one agent's questions replaced as a whole, then counted."""
    golden = AD.golden_questions(DriverTables(spark, sf_dir))
    incoming = golden.where("agent_name = 'BUILDING' AND version = 'v2' AND question_type <> 'trend'").withColumn("question_type", F.lit("revised"))
    return EV.golden_summary(EV.replace_version(golden, incoming))


REGISTRY["e03_evaluation_scores"] = evaluation_scores
REGISTRY["e04_golden_versions"] = golden_versions
