import datetime as dt

import duckdb
from pyspark.sql import functions as F

from piste.functions.core import (dow0, hour_boundary_diff, safe_div, surrogate_key, ts_text,
                                  year_boundary_diff)


def test_surrogate_key_matches_duckdb_restatement(spark):
    df = spark.createDataFrame([(1, "2020-11-01 00:00:00"), (None, None)], "id long, ts string")
    df = df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = [r.k for r in df.select(surrogate_key(F.col("id"), ts_text("ts")).alias("k")).collect()]
    con = duckdb.connect()
    token = "'_dbt_utils_surrogate_key_null_'"
    exp = [con.execute(
        f"SELECT md5(concat_ws('-', coalesce(CAST({i} AS VARCHAR), {token}), coalesce({t}, {token})))").fetchone()[0]
        for i, t in (("1", "strftime(TIMESTAMP '2020-11-01 00:00:00', '%Y-%m-%d %H:%M:%S.%g')"), ("NULL", "NULL"))]
    assert got == exp


def test_dialect_date_math(spark):
    row = spark.createDataFrame(
        [(dt.date(2000, 12, 31), dt.date(2001, 1, 1), dt.datetime(2024, 1, 1, 8, 50), dt.datetime(2024, 1, 1, 17, 10))],
        "a date, b date, s timestamp_ntz, e timestamp_ntz").select(
        year_boundary_diff("a", "b").alias("years"), hour_boundary_diff("s", "e").alias("hours"),
        dow0(F.lit("2024-01-07").cast("date")).alias("sunday"), dow0(F.lit("2024-01-06").cast("date")).alias("sat"),
        safe_div(F.lit(3), F.lit(0)).alias("div0"), safe_div(F.lit(3), F.lit(None).cast("int")).alias("divnull"),
    ).first()
    assert row.years == 1          # boundary count, not full years
    assert row.hours == 9          # 08:50 -> 17:10 crosses 9 hour boundaries
    assert (row.sunday, row.sat) == (0, 6)
    assert row.div0 is None and row.divnull is None
