import datetime as dt

from pyspark.sql import functions as F

from piste.operators import dims as D
from piste.operators import facts as FT
from piste.operators import staging as ST


def _day(rows, d):
    return rows.get(dt.date.fromisoformat(d))


def test_dim_date_season_edges_and_holidays(spark):
    rows = {r.full_date: r for r in D.dim_date(spark, "2020-10-25", 200, "2025-01-01").collect()}
    assert _day(rows, "2020-10-31") is None                      # off-season rows are dropped
    nov1 = _day(rows, "2020-11-01")
    assert (nov1.ski_season, nov1.season_month, nov1.week_of_season) == ("2020-2021", 1, 1)
    assert _day(rows, "2020-11-08").week_of_season == 2
    assert _day(rows, "2021-04-30").ski_season == "2020-2021"
    assert _day(rows, "2021-05-01") is None
    tg = _day(rows, "2020-11-26")                                # Thanksgiving: named, not a holiday
    assert tg.holiday_name == "Thanksgiving" and tg.is_holiday is False
    assert _day(rows, "2020-12-19").is_holiday is False and _day(rows, "2020-12-20").is_holiday is True
    assert _day(rows, "2021-01-05").is_holiday is True and _day(rows, "2021-01-06").is_holiday is False
    assert _day(rows, "2021-01-18").is_holiday is True            # MLK Monday
    assert _day(rows, "2021-02-15").is_holiday is True            # Presidents' Monday
    assert _day(rows, "2021-03-09").is_holiday is False and _day(rows, "2021-03-10").is_holiday is True
    assert _day(rows, "2021-03-24").is_holiday is True and _day(rows, "2021-03-25").is_holiday is False
    assert _day(rows, "2021-01-03").week_of_year == 53             # ISO week
    assert _day(rows, "2020-11-01").day_name == "Sun" and _day(rows, "2020-11-01").month_name == "Nov"
    assert _day(rows, "2021-01-15").snow_condition == "Excellent"
    assert _day(rows, "2020-11-01").date_key == 20201101


def test_age_groups_and_bands(spark):
    cust = spark.createDataFrame(
        [("a", dt.date(2008, 1, 1)), ("b", dt.date(2007, 1, 1)), ("c", dt.date(1991, 1, 1)),
         ("d", dt.date(1990, 1, 1)), ("e", dt.date(1971, 1, 1)), ("f", dt.date(1970, 1, 1)), ("g", None),
         (None, dt.date(1990, 1, 1))], "customer_id string, birth_date date")
    got = {r.customer_id: r.age_group for r in ST.stg_customers(cust, "2025-06-01").collect()}
    assert got == {"a": "Child", "b": "Young Adult", "c": "Young Adult", "d": "Adult", "e": "Adult",
                   "f": "Senior", "g": "Unknown"}       # NULL key dropped, NULL birth date -> Unknown
    nps = spark.createDataFrame([(1, 6), (2, 7), (3, 8), (4, 9), (5, None)], "feedback_id int, nps_score int")
    got = {r.feedback_id: r.nps_category for r in ST.stg_customer_feedback(nps).collect()}
    assert got == {1: "Detractor", 2: "Passive", 3: "Passive", 4: "Promoter", 5: "Detractor"}


def test_occupancy_weather_staffing_bands(spark):
    occ = spark.createDataFrame([(str(i), p) for i, p in enumerate([19.9, 20.0, 50.0, 80.0, 95.0, None])],
                                "record_id string, occupancy_percent double").withColumn(
        "total_spaces", F.lit(100)).withColumn("occupied_spaces", F.lit(10)).withColumn(
        "record_date", F.lit("2021-01-01")).withColumn("record_hour", F.lit(9))
    tiers = [r.occupancy_tier for r in ST.stg_parking_occupancy(occ).orderBy("record_id").collect()]
    assert tiers == ["Empty", "Low", "Moderate", "High", "Full", "Empty"]
    status = [r.s for r in occ.select(FT.occupancy_status(F.col("occupancy_percent")).alias("s")).collect()]
    assert status == ["Light", "Light", "Moderate", "Near Full", "Full", "Light"]
    w = spark.createDataFrame([("2021-01-01", 5.99, 24.9), ("2021-01-02", 6.0, 25.0), ("2021-01-03", None, None)],
                              "weather_date string, snowfall_inches double, wind_speed_mph double")
    for c in ("base_depth_inches", "temp_high_f", "temp_low_f", "storm_warning", "created_at"):
        w = w.withColumn(c, F.lit(None).cast("string"))
    flags = [(r.is_powder_day, r.is_high_wind) for r in ST.stg_weather_conditions(w).orderBy("weather_date").collect()]
    assert flags == [(False, False), (True, True), (False, False)]
    s = spark.createDataFrame([("1", 0.89), ("2", 0.90), ("3", None)], "schedule_id string, coverage_ratio double")
    for c in ("schedule_date", "shift_start", "shift_end", "scheduled_employees", "actual_employees", "created_at"):
        s = s.withColumn(c, F.lit(None).cast("string"))
    assert [r.is_understaffed for r in ST.stg_staffing_schedule(s).orderBy("schedule_id").collect()] == [
        True, False, False]


def test_severity_domains_differ_between_staging_and_fact(spark):
    sev = spark.createDataFrame([(s,) for s in ["minor", "Minor", "Major", "Critical", "serious", None]], "severity string")
    rows = sev.select(ST.staging_severity_score(F.col("severity")).alias("st"),
                      FT.fact_severity_score(F.col("severity")).alias("ft")).collect()
    assert [(r.st, r.ft) for r in rows] == [(1, 0), (0, 1), (0, 0), (0, 4), (3, 0), (0, 0)]


def test_patrol_minutes_cast_rounds_half_away_from_zero(spark):
    inc = spark.createDataFrame([("1", 12.5), ("2", 12.4)], "incident_id string, patrol_response_minutes double")
    for c in ("incident_date", "incident_timestamp", "severity"):
        inc = inc.withColumn(c, F.lit(None).cast("string"))
    got = [r.patrol_response_minutes for r in ST.stg_incidents(inc).orderBy("incident_id").collect()]
    assert got == [13, 12]


def test_scd2_merge_versions(spark):
    cur = spark.createDataFrame(
        [("c1", "gold", "2020-01-01 00:00:00"), ("c2", "silver", "2020-01-01 00:00:00")],
        "customer_id string, tier string, vf string").select(
        "customer_id", "tier", F.col("vf").cast("timestamp_ntz").alias("valid_from"),
        F.lit("9999-12-31 00:00:00").cast("timestamp_ntz").alias("valid_to"), F.lit(True).alias("is_current"))
    inc = spark.createDataFrame([("c1", "gold"), ("c2", "gold"), ("c3", "bronze")], "customer_id string, tier string")
    out = D.scd2_merge(cur, inc, "customer_id", ["tier"], "2021-01-01 00:00:00", key_name="k")
    rows = sorted((r.customer_id, r.tier, r.is_current, str(r.valid_from)[:10]) for r in out.collect())
    assert rows == [("c1", "gold", True, "2020-01-01"), ("c2", "gold", True, "2021-01-01"),
                    ("c2", "silver", False, "2020-01-01"), ("c3", "bronze", True, "2021-01-01")]
    assert out.select("k").distinct().count() == 4


def test_calendar_reaches_every_fact(spark):
    from piste.plans.star import Star
    star = Star(spark, "/root/testdata/sf0.001", spine_start="2001-01-01", spine_days=10)
    days = star["dim_date"].agg(F.min("full_date"), F.max("full_date")).first()
    raw = star.t.orders.agg(F.min("o_orderdate").cast("date")).first()[0], star.t.events.agg(F.max("ts").cast("date")).first()[0]
    assert days[0] <= raw[0] and days[1] >= raw[1]


def test_calendar_goes_on_to_the_last_fact_after_the_cutoff(spark):
    short = D.dim_date(spark, "2020-01-01", 4000, "2025-01-01")
    long = D.dim_date(spark, "2020-01-01", 4000, "2025-01-01", "2029-12-25")
    assert str(short.agg(F.max("full_date")).first()[0]) == "2027-01-01" and str(long.agg(F.max("full_date")).first()[0]) == "2029-12-25"
