"""Model monitoring and drift O01-O10 over a prediction log, as batch DataFrame jobs.

One log schema for every writer (run_id included: defects B11/B13 fixed); appends are
batch writes, backfill is a left join + ``coalesce`` (no correlated UPDATE), drift is
one conditional aggregation unpivoted with ``stack`` (each feature z-scored by its own
baseline deviation: B12 fixed).  ``as_of`` is always passed in; nothing reads a clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from piste.functions.core import safe_div
from piste.operators.incremental import path_exists, upsert

# Alert thresholds of the reference configuration.
THRESHOLDS = {"mae_warning": 150.0, "mae_critical": 250.0, "mape_warning": 25.0, "mape_critical": 40.0,
              "drift_zscore": 2.0}
DRIFT_FEATURES = ("lag_7", "lag_14", "rolling_7_mean")

LOG_COLUMNS = ["prediction_id", "run_id", "model_name", "model_version", "series", "prediction_timestamp",
               "forecast_date", "predicted_visitors", "actual_visitors", "day_of_week", "month", "is_weekend",
               "lag_7", "lag_14", "rolling_7_mean", "features_json", "request_source"]


def log_from_predictions(pred: DataFrame, series: str, date_col: str, prediction: str, model_name: str,
                         model_version, run_id, request_source: str = "batch") -> DataFrame:
    """O01 input: shape scored rows into the unified prediction-log schema."""
    d = F.col(date_col)
    return pred.select(
        F.md5(F.concat_ws("|", F.col(series).cast("string"), d.cast("string"), F.lit(model_name))).alias("prediction_id"),
        run_id.alias("run_id"), F.lit(model_name).alias("model_name"), model_version.alias("model_version"),
        F.col(series).cast("string").alias("series"),
        (d.cast("timestamp_ntz") - F.make_dt_interval(F.lit(1))).alias("prediction_timestamp"),
        d.alias("forecast_date"), F.col(prediction).cast("bigint").alias("predicted_visitors"),
        F.lit(None).cast("bigint").alias("actual_visitors"),
        F.col("day_of_week").cast("int").alias("day_of_week"), F.col("month").cast("int").alias("month"),
        F.col("is_weekend").cast("boolean").alias("is_weekend"),
        *[F.col(c).cast("double").alias(c) for c in DRIFT_FEATURES],
        F.to_json(F.struct(*[F.col(c) for c in DRIFT_FEATURES])).alias("features_json"),
        F.lit(request_source).alias("request_source"),
    )


#: What names a prediction: a run predicts a series' day once.
LOG_KEY = ["series", "forecast_date", "run_id"]


def append_predictions(log: DataFrame, path: str) -> None:
    """One batch append (not row-by-row inserts) of the predictions whose key the log lacks, so
    that writing a run again adds nothing."""
    new = log.select(*LOG_COLUMNS).dropDuplicates(LOG_KEY)
    if path_exists(log.sparkSession, path):
        new = new.join(log.sparkSession.read.parquet(path).select(*LOG_KEY), LOG_KEY, "left_anti")
    new.write.mode("append").partitionBy("run_id").parquet(path)


def backfill_log(spark: SparkSession, path: str, actuals: DataFrame, as_of: str) -> None:
    """O02 on the written log: rows that are due get their actual value, by key; only runs that hold
    such rows are rewritten, and running it again changes nothing."""
    log = spark.read.parquet(path)
    due = log.where(F.col("actual_visitors").isNull() & (F.col("forecast_date") < F.lit(as_of).cast("date")))
    upsert(spark, backfill_actuals(due, actuals, as_of), path, LOG_KEY, partition_col="run_id")


def backfill_actuals(log: DataFrame, actuals: DataFrame, as_of: str, series: str = "series",
                     date_col: str = "forecast_date", value: str = "actual") -> DataFrame:
    """Past rows without an actual get the observed value, 0 when nothing was observed."""
    a = actuals.select(F.col(series).cast("string").alias("__s"), F.col(date_col).alias("__d"),
                       F.col(value).cast("bigint").alias("__a"))
    j = log.join(a, (F.col("series") == F.col("__s")) & (F.col("forecast_date") == F.col("__d")), "left")
    due = F.col("actual_visitors").isNull() & (F.col("forecast_date") < F.lit(as_of).cast("date"))
    filled = F.when(due, F.coalesce(F.col("__a"), F.lit(0))).otherwise(F.col("actual_visitors"))
    return j.withColumn("actual_visitors", filled).drop("__s", "__d", "__a")


def with_errors(log: DataFrame) -> DataFrame:
    """Error, absolute and percentage error (NULL when actual <= 0 or missing)."""
    p, a = F.col("predicted_visitors"), F.col("actual_visitors")
    return log.withColumn("error", (p - a).cast("double")).withColumn(
        "absolute_error", F.abs(p - a).cast("double")).withColumn(
        "percentage_error", F.when(a > 0, F.abs(p - a) / a * 100))


def daily_performance(log: DataFrame) -> DataFrame:
    """Per forecast day and model version (model_version projected: B11 fixed)."""
    e = with_errors(log).filter(F.col("actual_visitors").isNotNull())
    return e.groupBy("forecast_date", "model_version").agg(
        F.count(F.lit(1)).alias("prediction_count"), F.avg("predicted_visitors").alias("avg_predicted"),
        F.avg("actual_visitors").alias("avg_actual"), F.avg("absolute_error").alias("mae"),
        F.avg("percentage_error").alias("mape"), F.stddev_samp("percentage_error").alias("mape_stddev"))


def status(mae, mape, t: dict = THRESHOLDS):
    return (F.when(mae.isNull() | mape.isNull(), "unknown")
            .when((mae > t["mae_critical"]) | (mape > t["mape_critical"]), "critical")
            .when((mae > t["mae_warning"]) | (mape > t["mape_warning"]), "warning")
            .otherwise("healthy"))


def recent_performance(log: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Last ``days`` of predictions with actuals -> count, MAE, MAPE, max error, status."""
    since = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    e = with_errors(log).filter(F.col("actual_visitors").isNotNull() & (F.col("prediction_timestamp") >= since))
    agg = e.agg(F.count(F.lit(1)).alias("prediction_count"), F.avg("absolute_error").alias("mae"),
                F.avg(safe_div(F.abs(F.col("predicted_visitors") - F.col("actual_visitors")) * 100,
                               F.col("actual_visitors"))).alias("mape"),
                F.max("absolute_error").alias("max_error"))
    return agg.withColumn("status", status(F.col("mae"), F.col("mape")))


def feature_drift(log: DataFrame, as_of: str, recent_days: int = 7, baseline_days: int = 30,
                  features=DRIFT_FEATURES) -> DataFrame:
    """Mean of each feature over the last ``recent_days`` vs days recent..baseline,
    z = |recent - baseline| / baseline stddev of the same feature; one pass + unpivot."""
    ts = F.col("prediction_timestamp")
    now = F.lit(as_of).cast("timestamp_ntz")
    recent = ts >= now - F.make_dt_interval(F.lit(recent_days))
    base = (ts >= now - F.make_dt_interval(F.lit(baseline_days))) & ~recent
    aggs = []
    for f in features:
        aggs += [F.avg(F.when(recent, F.col(f))).alias(f"{f}__r"), F.avg(F.when(base, F.col(f))).alias(f"{f}__b"),
                 F.stddev_samp(F.when(base, F.col(f))).alias(f"{f}__s")]
    wide = log.agg(*aggs)
    stack = ", ".join(f"'{f}', `{f}__r`, `{f}__b`, `{f}__s`" for f in features)
    long = wide.selectExpr(f"stack({len(features)}, {stack}) AS (feature, recent_mean, baseline_mean, baseline_std)")
    z = safe_div(F.abs(F.col("recent_mean") - F.col("baseline_mean")), F.col("baseline_std"))
    return long.withColumn("z_score_drift", z).withColumn(
        "drift_alert", F.coalesce(F.col("z_score_drift") > THRESHOLDS["drift_zscore"], F.lit(False)))


def metrics_by_version(log: DataFrame) -> DataFrame:
    """Accuracy per model version."""
    e = with_errors(log).filter(F.col("actual_visitors").isNotNull())
    return e.groupBy("model_version").agg(
        F.count(F.lit(1)).alias("predictions"), F.avg("absolute_error").alias("mae"),
        F.avg("percentage_error").alias("mape"), F.avg("error").alias("mean_error"))


def retrain_decision(log: DataFrame, series: str = "series", recent_n: int = 7) -> DataFrame:
    """Most recent ``recent_n`` days vs older days (per series):
    recent MAPE > 25 -> retrain_required; > 1.5x older -> drift_detected; < 15 -> healthy;
    else monitor."""
    from pyspark.sql import Window

    e = with_errors(log).filter(F.col("actual_visitors").isNotNull())
    w = Window.partitionBy(series).orderBy(F.col("forecast_date").desc())
    e = e.withColumn("__rn", F.row_number().over(w))
    agg = e.groupBy(series).agg(F.avg(F.when(F.col("__rn") <= recent_n, F.col("percentage_error"))).alias("recent_mape"),
                                F.avg(F.when(F.col("__rn") > recent_n, F.col("percentage_error"))).alias("older_mape"))
    older = F.coalesce(F.col("older_mape"), F.col("recent_mape"))
    rec = F.col("recent_mape")
    decision = (F.when(rec > 25, "retrain_required").when(rec > older * 1.5, "drift_detected")
                .when(rec < 15, "healthy").otherwise("monitor"))
    return agg.withColumn("older_mape", older).withColumn("decision", decision)


def bias_check(log: DataFrame, series: str = "series") -> DataFrame:
    """Mean signed error beyond +-10 visitors flags over/under prediction."""
    e = with_errors(log).filter(F.col("actual_visitors").isNotNull())
    agg = e.groupBy(series).agg(F.avg("error").alias("mean_error"))
    m = F.col("mean_error")
    return agg.withColumn("bias", F.when(m > 10, "overpredicts").when(m < -10, "underpredicts").otherwise("minimal"))
