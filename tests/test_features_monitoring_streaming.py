import datetime as dt

from pyspark.sql import functions as F

from piste.operators import features as FE
from piste.operators import monitoring as MO
from piste.streaming import facts as SF


def _series(spark):
    days = [dt.date(2021, 1, 1) + dt.timedelta(days=i) for i in range(10) if i != 5]   # a gap on day 6
    return spark.createDataFrame([("e", d, float(i + 1)) for i, d in enumerate(days)], "ent string, d date, y double")


def test_lags_by_row_position_and_rolling(spark):
    cfg = FE.FeatureConfig(features=[], lags=[1], windows=[2], target="y")
    rows = FE.engineer(_series(spark), cfg, "d", "ent", drop_warmup=False).orderBy("d").collect()
    assert rows[5].d == dt.date(2021, 1, 7) and rows[5].lag_1 == 5.0          # previous *row*, across the gap
    assert rows[0].rolling_2_mean is None and rows[2].rolling_2_mean == 1.5   # excludes the current row
    leaky = FE.engineer(_series(spark), cfg, "d", "ent", leaky=True, drop_warmup=False).orderBy("d").collect()
    assert leaky[0].rolling_2_mean == 1.0 and leaky[2].rolling_2_mean == 2.5
    assert FE.engineer(_series(spark), cfg, "d", "ent").count() == 9 - 2      # warm-up = max(lags, windows)


def test_config_merge_and_categorical_normalization(spark):
    cfg = FE.build_config({"include": ["date_features", "weather_features"], "exclude": ["is_holiday"],
                           "override": {"snowfall_inches": {"dtype": "int"}}}, env={"lag_features": {"lags": [7]}})
    names = [s["name"] for s in cfg.features]
    assert "is_holiday" not in names and cfg.lags == [7]
    df = spark.createDataFrame([("Packed Powder",), ("ICY",), ("slush",)], "SNOW_CONDITION string")
    spec = [s for s in cfg.features if s["name"] == "snow_condition_encoded"][0]
    out = FE.engineer(df.withColumn("d", F.current_date()), FE.FeatureConfig(features=[spec], lags=[], windows=[]),
                      "d", drop_warmup=False)
    assert [r.snow_condition_encoded for r in out.collect()] == [2, 0, 1]


def test_backfill_and_errors(spark):
    log = spark.createDataFrame([("s", dt.date(2021, 1, 1), 10), ("s", dt.date(2021, 1, 2), 10),
                                 ("s", dt.date(2021, 1, 9), 10)],
                                "series string, forecast_date date, predicted_visitors long").withColumn(
        "actual_visitors", F.lit(None).cast("bigint"))
    act = spark.createDataFrame([("s", dt.date(2021, 1, 1), 8)], "series string, forecast_date date, actual long")
    b = MO.with_errors(MO.backfill_actuals(log, act, "2021-01-05")).orderBy("forecast_date").collect()
    assert [r.actual_visitors for r in b] == [8, 0, None]      # no visits -> 0; future stays open
    assert b[0].percentage_error == 25.0 and b[1].percentage_error is None


def test_stream_dedup_and_hourly_windows(spark, scratch):
    rows = [(1, "2024-01-01 00:10:00", "click", 1.0), (1, "2024-01-01 00:10:00", "click", 1.0),
            (2, "2024-01-01 00:50:00", "click", 2.0), (3, "2024-01-01 01:05:00", "view", 5.0)]
    src = f"{scratch}/src"
    spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")).write.parquet(src)
    s = SF.file_stream(spark, src, spark.read.parquet(src).schema)
    agg = SF.hourly_load(SF.dedup_within_watermark(s, "ts", ["event_id"], "1 hour"), "ts", "event_type", "value", None)
    q = (agg.writeStream.outputMode("update").foreachBatch(SF.upsert_batch(f"{scratch}/out", ["window_start", "event_type"]))
         .option("checkpointLocation", f"{scratch}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted((str(r.window_start), r.event_type, r.events, r.value_sum) for r in spark.read.parquet(f"{scratch}/out").collect())
    assert got == [("2024-01-01 00:00:00", "click", 2, 3.0), ("2024-01-01 01:00:00", "view", 1, 5.0)]


def test_future_frame_fallbacks(spark):
    from piste.operators import forecast as FC

    # history: Jan 1-10 2021 for entity e (values 10..19), nothing for entity z before Jan 12
    hist = [("e", dt.date(2021, 1, 1) + dt.timedelta(days=i), float(10 + i)) for i in range(10)]
    hist += [("z", dt.date(2020, 12, 1), 5.0)]
    h = spark.createDataFrame(hist, "ent string, d date, y double")
    fut = {(r.ent, r.d): r for r in FC.future_frame(h, "d", "y", "2021-01-12", 3, entity="ent",
                                                  lags=(7, 14), windows=(7,)).collect()}
    e12 = fut[("e", dt.date(2021, 1, 12))]
    assert e12.lag_7 == 14.0                       # Jan 5 is known
    # Dec 29 unknown -> January weekday mean for that weekday (Tue): only Jan 5 -> 14.0
    assert e12.lag_14 == 14.0
    assert e12.rolling_7_mean == sum(range(14, 20)) / 6   # Jan 5..10 known within [d-7, d-1]
    z12 = fut[("z", dt.date(2021, 1, 12))]
    assert (z12.lag_7, z12.lag_14, z12.rolling_7_mean) == (400.0, 400.0, 400.0)   # nothing known -> default
    assert len(fut) == 6 and e12.day_of_week == 1 and e12.month == 1


def test_staffing_band_and_clamp(spark):
    from piste.operators import forecast as FC

    df = spark.createDataFrame([(-3.2,), (499.9,), (500.0,), (2999.0,), (3000.0,)], "p double")
    rows = df.select(FC.clamp_prediction(F.col("p")).alias("v")).select(
        "v", FC.staffing_band(F.col("v")).alias("band")).collect()
    assert [(r.v, r.band) for r in rows] == [(0, "minimal"), (499, "minimal"), (500, "light"), (2999, "high"),
                                             (3000, "peak")]
