"""Forecasting pipeline P01-P03 and P14-P24 as Spark jobs.

The reference collects three SQL aggregates to pandas and loops over forecast days in
Python; here the same steps are one plan: calendar rows x entities, lag/rolling
look-ups by an equi-join on (entity, date - offset), fallbacks with ``coalesce``, model
scoring with MLlib, staffing bands with a ``when`` chain.  Nothing is collected except
one-row summaries.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piste.functions.core import dow0, safe_div
from piste.operators.features import FeatureConfig, feature_columns

# Fallbacks of the reference's forecast path.
DEFAULT_LAG_VALUE = 400.0
WEATHER_DEFAULTS = {"snowfall_inches": 5.0, "base_depth_inches": 100.0, "avg_temp_f": 28.0, "wind_speed_mph": 12.0}
POWDER_RATE_THRESHOLD = 0.3
# Staffing levels (upper bound of predicted visitors, exclusive) and quality gates.
STAFFING_LEVELS = [("minimal", 500, "6-8", "1 location"), ("light", 1000, "10-12", "2 locations"),
                   ("moderate", 2000, "14-16", "3 locations"), ("high", 3000, "18-20", "4 locations")]
PEAK_LEVEL = ("peak", None, "22+", "all locations")
QUALITY_GATES = {"min_r2": 0.70, "max_mae": 200.0, "max_mape": 25.0}


def daily_weather(fact_weather: DataFrame) -> DataFrame:
    """Weather collapsed over zones: max condition (lexicographic, as the reference),
    summed snow, mean base/temperature, max wind, any powder / high wind."""
    return fact_weather.groupBy("date_key").agg(
        F.max("snow_condition").alias("SNOW_CONDITION"),
        F.sum("snowfall_inches").alias("SNOWFALL_INCHES"),
        F.avg("base_depth_inches").alias("BASE_DEPTH_INCHES"),
        F.avg("avg_temp_f").alias("AVG_TEMP_F"),
        F.max("wind_speed_mph").alias("WIND_SPEED_MPH"),
        F.max(F.col("is_powder_day").cast("int")).alias("IS_POWDER_DAY"),
        F.max(F.col("is_high_wind").cast("int")).alias("IS_HIGH_WIND"),
    )


def training_frame(dim_date: DataFrame, fact_pass_usage: DataFrame, fact_weather: DataFrame,
                   entity: tuple[str, DataFrame, str] | None = None, as_of: str | None = None,
                   years_back: int | None = None) -> DataFrame:
    """Calendar x daily distinct visitors x daily weather (inner joins, visitors > 0).

    ``entity=(name, dim, key)`` turns the resort series into a panel, e.g.
    ``("CUSTOMER_SEGMENT", dim_customer, "customer_key")`` -> one series per segment.
    """
    pu = fact_pass_usage
    group = [F.col("date_key")]
    if entity is not None:
        name, dim, key = entity
        pu = pu.join(dim.select(key, F.col(name.lower()).alias(name)), key, "left")
        group.append(F.col(name))
    visitors = pu.groupBy(*group).agg(F.countDistinct("customer_key").alias("UNIQUE_VISITORS"))
    d = dim_date.select("date_key", F.col("full_date").alias("FULL_DATE"), F.col("day_of_week").alias("DAY_OF_WEEK"),
                        F.col("month_num").alias("MONTH"), F.col("is_weekend").alias("IS_WEEKEND"),
                        F.col("is_holiday").alias("IS_HOLIDAY"))
    out = F.broadcast(d).join(visitors, "date_key").join(daily_weather(fact_weather), "date_key")
    out = out.filter(F.col("UNIQUE_VISITORS") > 0)
    if as_of is not None:
        hi = F.lit(as_of).cast("date")
        out = out.filter(F.col("FULL_DATE") < hi)
        if years_back is not None:
            out = out.filter(F.col("FULL_DATE") >= F.add_months(hi, -12 * years_back))
    return out.drop("date_key")


def _calendar_visits(dim_date: DataFrame, fact_pass_usage: DataFrame, lo, hi) -> DataFrame:
    """Calendar rows in [lo, hi) left-joined to visits pre-aggregated per day (the fact is
    reduced to one row per date before the join; the join never fans out)."""
    d = dim_date.filter(F.col("full_date") >= lo)
    if hi is not None:
        d = d.filter(F.col("full_date") < hi)
    agg = fact_pass_usage.groupBy("date_key").agg(
        F.countDistinct("customer_key").alias("__uv"), F.count(F.lit(1)).alias("__n"),
        F.sum("total_lift_rides").alias("__rides"))
    return d.join(agg, "date_key", "left")


def simple_training_frame(dim_date: DataFrame, fact_pass_usage: DataFrame, as_of: str, years_back: int) -> DataFrame:
    """Every calendar day of the window with its visits; as the reference's LEFT JOIN
    + COUNT(*), an empty day counts one visit row, zero visitors and NULL rides."""
    hi = F.lit(as_of).cast("date")
    j = _calendar_visits(dim_date, fact_pass_usage, F.add_months(hi, -12 * years_back), hi)
    return j.select(
        F.col("full_date").alias("FULL_DATE"), F.col("day_name").alias("DAY_NAME"),
        F.col("day_of_week").alias("DAY_OF_WEEK"), F.col("month_num").alias("MONTH_NUM"),
        F.col("month_name").alias("MONTH_NAME"), F.col("ski_season").alias("SKI_SEASON"),
        F.col("is_weekend").alias("IS_WEEKEND"), F.col("is_holiday").alias("IS_HOLIDAY"),
        F.col("snow_condition").alias("SNOW_CONDITION"),
        F.coalesce("__uv", F.lit(0)).alias("UNIQUE_VISITORS"), F.coalesce("__n", F.lit(1)).alias("TOTAL_VISITS"),
        F.col("__rides").alias("TOTAL_LIFT_RIDES"))


def history_for_lags(dim_date: DataFrame, fact_pass_usage: DataFrame, as_of: str, days_back: int) -> DataFrame:
    """Calendar-densified distinct visitors for the last ``days_back`` days (0 when none)."""
    lo = F.date_sub(F.lit(as_of).cast("date"), days_back)
    j = _calendar_visits(dim_date, fact_pass_usage, lo, None)
    return j.select(
        F.col("full_date").alias("FULL_DATE"), F.col("day_of_week").alias("DAY_OF_WEEK"),
        F.col("month_num").alias("MONTH_NUM"), F.col("is_weekend").alias("IS_WEEKEND"),
        F.col("is_holiday").alias("IS_HOLIDAY"), F.col("snow_condition").alias("SNOW_CONDITION"),
        F.coalesce("__uv", F.lit(0)).alias("UNIQUE_VISITORS"))


def daily_series(fact_pass_usage: DataFrame, date_col: str = "visit_date") -> DataFrame:
    """P02/P03 source: distinct visitors per calendar day."""
    return fact_pass_usage.groupBy(F.col(date_col).alias("FULL_DATE")).agg(
        F.countDistinct("customer_key").alias("UNIQUE_VISITORS"))


def densify(series: DataFrame, date_col: str, value_col: str, start: str, end: str) -> DataFrame:
    """One row per calendar day in [start, end]; days without rows -> 0."""
    cal = series.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias(date_col))
    return cal.join(series, date_col, "left").select(
        date_col, F.coalesce(F.col(value_col), F.lit(0)).alias(value_col))


def weekday_means(history: DataFrame, date_col: str, target: str, month: int | None = None,
                  entity: str | None = None) -> DataFrame:
    """Mean target by weekday (Monday = 0, one convention: B9 fixed), optionally for one month."""
    h = history
    if month is not None:
        h = h.filter(F.month(date_col) == month)
    keys = ([entity] if entity else []) + [((F.dayofweek(date_col) + 5) % 7).alias("weekday")]
    return h.groupBy(*keys).agg(F.avg(F.col(target).cast("double")).alias("weekday_mean"))


def weekday_means_by_month(history: DataFrame, date_col: str, target: str, entity: str | None = None) -> DataFrame:
    """P19 for every month in one pass: mean target by month and weekday (Monday = 0)."""
    keys = ([entity] if entity else []) + [F.month(date_col).alias("month"), ((F.dayofweek(date_col) + 5) % 7).alias("weekday")]
    return history.groupBy(*keys).agg(F.avg(F.col(target).cast("double")).alias("weekday_mean"))


#: Columns whose monthly mean is a normal.
NORMALS = ("snowfall_inches", "base_depth_inches", "avg_temp_f", "wind_speed_mph")


def _normals(grouped) -> DataFrame:
    return grouped.agg(*[F.coalesce(F.avg(c), F.lit(WEATHER_DEFAULTS[c])).alias(c) for c in NORMALS],
                       (F.coalesce(F.avg(F.col("is_powder_day").cast("int")), F.lit(0.0)) > POWDER_RATE_THRESHOLD).cast("int").alias("is_powder_day"),
                       F.lit(0).alias("is_high_wind"))


def weather_normals(fact_weather: DataFrame, dim_date: DataFrame, month: int) -> DataFrame:
    """P20: one-row monthly weather normals with the reference's defaults."""
    d = dim_date.filter(F.col("month_num") == month).select("date_key")
    return _normals(fact_weather.join(d, "date_key").groupBy())


def weather_normals_by_month(fact_weather: DataFrame, dim_date: DataFrame) -> DataFrame:
    """P20 for every month that has observations, in one pass: month and its normals."""
    return _normals(fact_weather.join(dim_date.select("date_key", F.col("month_num").alias("month")), "date_key").groupBy("month"))


def future_frame(history: DataFrame, date_col: str, target: str, start: str, days: int,
                 entity: str | None = None, lags=(7, 14, 21, 28), windows=(7, 14, 30)) -> DataFrame:
    """Forecast rows for ``days`` days from ``start`` with lag/rolling inputs.

    Lag k = actual value at d-k if known, else the weekday mean of the start month for
    that weekday, else 400.  Rolling n = mean of known values in [d-n, d-1], else 400.
    Lookups are one equi-join of (entity, d - offset) against history (bounded fan-out:
    ``max(lags, windows)`` rows per forecast row).
    """
    spark = history.sparkSession
    ents = history.select(entity).distinct() if entity else spark.range(1).select(F.lit("all").alias("__e"))
    ekey = entity or "__e"
    # entities x forecast days: the day list is ``days`` rows, so it is broadcast and
    # each entity row is expanded locally (no shuffle, output = entities * days)
    fut = ents.select(ekey, F.explode(F.sequence(F.lit(start).cast("date"),
                                                 F.date_add(F.lit(start).cast("date"), days - 1))).alias(date_col))
    span = max(list(lags) + list(windows))
    probe = fut.select(ekey, date_col, F.explode(F.sequence(F.lit(1), F.lit(span))).alias("__off"))
    probe = probe.withColumn("__hdate", F.date_sub(F.col(date_col), F.col("__off")))
    h = history.select(*( [F.col(entity)] if entity else [F.lit("all").alias("__e")]),
                       F.col(date_col).alias("__hdate"), F.col(target).cast("double").alias("__y"))
    j = probe.join(h, [ekey, "__hdate"], "left")
    aggs = [F.max(F.when(F.col("__off") == k, F.col("__y"))).alias(f"__lag_{k}") for k in lags]
    aggs += [F.avg(F.when(F.col("__off") <= n, F.col("__y"))).alias(f"rolling_{n}_mean") for n in windows]
    feats = j.groupBy(ekey, date_col).agg(*aggs)
    month = int(start[5:7])
    wk = weekday_means(history if entity else history.withColumn("__e", F.lit("all")), date_col, target, month, ekey)
    out = feats
    for k in lags:
        wd = ((F.dayofweek(F.date_sub(F.col(date_col), k)) + 5) % 7)
        m = wk.select(F.col(ekey).alias("__we"), F.col("weekday").alias(f"__wd{k}"), F.col("weekday_mean").alias(f"__wm{k}"))
        # weekday means: 7 rows per entity -- broadcast only while the entity count is bounded
        out = out.withColumn(f"__wdk{k}", wd).join(
            m, (F.col(ekey) == F.col("__we")) & (F.col(f"__wdk{k}") == F.col(f"__wd{k}")),
            "left").drop(
            "__we", f"__wd{k}", f"__wdk{k}")
        out = out.withColumn(f"lag_{k}", F.coalesce(F.col(f"__lag_{k}"), F.col(f"__wm{k}"), F.lit(DEFAULT_LAG_VALUE)))
        out = out.drop(f"__lag_{k}", f"__wm{k}")
    for n in windows:
        out = out.withColumn(f"rolling_{n}_mean", F.coalesce(F.col(f"rolling_{n}_mean"), F.lit(DEFAULT_LAG_VALUE)))
    d = F.col(date_col)
    out = out.withColumn("day_of_week", ((F.dayofweek(d) + 5) % 7).cast("int")).withColumn(
        "month", F.month(d)).withColumn("is_weekend", dow0(d).isin(0, 6).cast("int"))
    return out if entity else out.drop("__e")


def train_gbt(train: DataFrame, features: list[str], label: str, max_iter: int = 40, max_depth: int = 5,
              step_size: float = 0.1, validation_col: str | None = None, seed: int = 42):
    """Gradient-boosted trees (MLlib); ``validation_col`` enables early stopping."""
    asm = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    gbt = GBTRegressor(featuresCol="features", labelCol=label, maxIter=max_iter, maxDepth=max_depth,
                       stepSize=step_size, seed=seed, subsamplingRate=0.8, validationTol=0.01)
    if validation_col:
        gbt = gbt.setValidationIndicatorCol(validation_col)
    return Pipeline(stages=[asm, gbt]).fit(train)


def best_iteration(model) -> int:
    """How many trees early stopping kept."""
    return model.stages[-1].getNumTrees


def refit_all(frame: DataFrame, validated, features: list[str], label: str, **options):
    """The production model, fitted to all rows with as many trees as the validation run kept."""
    return train_gbt(frame, features, label, max_iter=best_iteration(validated), **options)


def regression_metrics(pred: DataFrame, label: str, prediction: str = "prediction",
                       group: list[str] | None = None) -> DataFrame:
    """MAE, RMSE, MAPE (rows with label > 0), R^2 as one aggregation (per group)."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    err = p - y
    keys = group or []
    base = pred.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.avg(F.when(y > 0, F.abs(err) / y)) * 100).alias("mape"),
        F.sum(err * err).alias("__sse"), F.var_pop(y).alias("__var"))
    return base.withColumn("r2", 1 - safe_div(F.col("__sse"), F.col("__var") * F.col("n"))).drop("__sse", "__var")


def quality_gate(metrics: DataFrame, gates: dict = QUALITY_GATES) -> DataFrame:
    """pass/fail of the one-row (per group) metrics against the gates."""
    ok = ((F.col("r2") >= gates["min_r2"]) & (F.col("mae") <= gates["max_mae"]) & (F.col("mape") <= gates["max_mape"]))
    return metrics.withColumn("gate_passed", F.coalesce(ok, F.lit(False)))


def feature_importance(model, features: list[str], k: int = 10) -> list[tuple[str, float]]:
    """Top-k features by importance (model metadata, already on the driver)."""
    imp = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, map(float, imp)), key=lambda t: -t[1])[:k]


def clamp_prediction(c) -> F.Column:
    """Predictions are non-negative whole visitors."""
    return F.floor(F.greatest(F.lit(0.0), c)).cast("bigint")


def staffing_band(visitors) -> F.Column:
    """Staffing level for predicted visitors (fixed, 5-row table -> when chain)."""
    expr = None
    for name, upper, _, _ in STAFFING_LEVELS:
        expr = F.when(visitors < upper, name) if expr is None else expr.when(visitors < upper, name)
    return expr.otherwise(PEAK_LEVEL[0])


MOST_BANDS = 1000


def default_bands(spark) -> DataFrame:
    """The fixed staffing levels as a band table."""
    rows, low = [], 0
    for name, high, lifts, food in [*STAFFING_LEVELS, PEAK_LEVEL]:
        rows.append((name, low, high, lifts, food))
        low = high
    return spark.createDataFrame(rows, "level string, min_visitors long, max_visitors long, lift_operators string, f_and_b string")


def checked_bands(bands: DataFrame) -> list:
    """The band table's rows in order.  Bands are [min_visitors, max_visitors), from 0 on, the last one
    without end; gaps, overlaps, empty bands and more than MOST_BANDS rows are errors."""
    rows = bands.orderBy("min_visitors").limit(MOST_BANDS + 1).collect()
    if not rows or len(rows) > MOST_BANDS:
        raise ValueError(f"a band table has 1 to {MOST_BANDS} rows")
    if rows[0]["min_visitors"] != 0 or rows[-1]["max_visitors"] is not None:
        raise ValueError("bands start at 0 and the last one has no upper end")
    for a, b in zip(rows, rows[1:]):
        if a["max_visitors"] is None or a["max_visitors"] <= a["min_visitors"] or a["max_visitors"] != b["min_visitors"]:
            raise ValueError(f"gap or overlap between bands {a['level']} and {b['level']}")
    return rows


def assign_bands(df: DataFrame, value: str, bands: DataFrame) -> DataFrame:
    """Each row with the columns of the band that its value lies in (null for null or negative
    values).  The checked bands travel in the plan as one sorted array, searched by halving: a range
    join without pairs."""
    rows = checked_bands(bands)
    extra = [c for c in bands.columns if c not in ("min_visitors", "max_visitors")]
    table = F.array(*[F.struct(F.lit(r["min_visitors"]).cast("double").alias("low"), *[F.lit(r[c]).alias(c) for c in extra]) for r in rows])
    steps = F.array(*[F.lit(1 << p) for p in range(len(rows).bit_length() - 1, -1, -1)])
    v = F.col(value).cast("double")
    place = F.aggregate(steps, F.lit(0), lambda d, p: F.when((d + p < len(rows)) & (F.get(table, d + p)["low"] <= v), d + p).otherwise(d))
    return df.withColumn("__band", F.when(v >= 0, F.get(table, place))).select("*", *[F.col(f"__band.{c}").alias(c) for c in extra]).drop("__band")


def forecast_summary(forecast: DataFrame, date_col: str, value: str, entity: str | None = None) -> DataFrame:
    """Total, mean and peak day of a forecast (per entity); of equal peaks the first day."""
    keys = [entity] if entity else []
    return forecast.groupBy(*keys).agg(
        F.sum(value).alias("total_visitors"), F.avg(value).alias("avg_visitors"),
        F.min_by(F.col(date_col), F.struct(-F.col(value), F.col(date_col))).alias("peak_date"), F.max(value).alias("peak_visitors"),
        F.count(F.lit(1)).alias("days"))


def weekday_weekend_profile(frame: DataFrame, target: str, weekend_col: str = "IS_WEEKEND",
                            entity: str | None = None) -> DataFrame:
    """Mean, std, count and median of the target for weekdays vs weekends."""
    keys = ([entity] if entity else []) + [weekend_col]
    y = F.col(target).cast("double")
    return frame.groupBy(*keys).agg(F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"),
                                    F.count(F.lit(1)).alias("days"), F.median(y).alias("median"))


def model_inputs(df: DataFrame, cfg: FeatureConfig) -> list[str]:
    return feature_columns(df, cfg)
