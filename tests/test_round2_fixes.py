"""Upserts across partitions, empty targets, streams over folders, SQL clauses, future features."""


import pytest
from pyspark.sql import functions as F

from piste.operators import evaluation, features, incremental, text
from piste.plans import catalog
from piste.streaming import facts
from tests.conftest import SF_SMALL


def test_a_key_that_changes_partition_leaves_one_row(spark, scratch):
    make = lambda rows: spark.createDataFrame(rows, "k string, p string, v int")
    incremental.upsert(spark, make([("k1", "a b/1", 1), ("k2", "p2", 2), ("k3", None, 3)]), scratch, "k", partition_col="p")
    incremental.upsert(spark, make([("k1", "p2", 9), ("k3", "p2", 8)]), scratch, "k", partition_col="p")
    got = sorted((r["k"], r["p"], r["v"]) for r in spark.read.parquet(scratch).collect())
    assert got == [("k1", "p2", 9), ("k2", "p2", 2), ("k3", "p2", 8)]
    incremental.upsert(spark, make([("k2", "a b/1", 5)]), scratch, "k", partition_col="p")
    got = sorted((r["k"], r["p"], r["v"]) for r in spark.read.parquet(scratch).collect())
    assert got == [("k1", "p2", 9), ("k2", "a b/1", 5), ("k3", "p2", 8)]


def test_an_empty_target_loads_again(spark, scratch):
    source = spark.createDataFrame([("a", 1), ("b", 2)], "k string, t int")
    load = lambda s: incremental.incremental_load(spark, lambda d: d, s, scratch, "k", "t")
    load(source.limit(0))
    load(source)
    assert spark.read.parquet(scratch).count() == 2


@pytest.mark.parametrize("name", ["events", "lineitem"])
def test_streams_read_folders_of_part_files(spark, scratch, name):
    table = spark.read.parquet(f"{SF_SMALL}/{name}.parquet")
    table.repartition(4).write.parquet(f"{scratch}/{name}.parquet")
    stream = facts.table_stream(spark, scratch, name, max_files_per_trigger=1)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{scratch}/c").option(
        "path", f"{scratch}/o").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(f"{scratch}/o").count() == table.count()


def test_hourly_load_over_a_folder_equals_the_single_file(spark, scratch):
    table = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    table.repartition(5).write.parquet(f"{scratch}/events.parquet")
    rows = lambda d: sorted(map(str, catalog.stream_hourly_event_load(spark, d).select(
        "window_start", "event_type", "events", F.round("value_sum", 4)).collect()))
    assert rows(scratch) == rows(SF_SMALL)


def test_sql_clauses(spark):
    sql = ("SELECT season, SUM(x) FROM db.fact_sales f JOIN dim_date d ON f.k = d.k WHERE f.region = 'a' AND amount > 3 "
           "GROUP BY SEASON, CUSTOMER_SEGMENT HAVING SUM(x) > 1 ORDER BY season LIMIT 5")
    got = spark.createDataFrame([(sql,)], "q string").select(evaluation.sql_tokens(F.col("q")).alias("t")).first()["t"]
    assert got["group_by"] == ["SEASON", "CUSTOMER_SEGMENT"]
    assert set(got["tables"]) == {"FACT_SALES", "DIM_DATE"} and set(got["filters"]) == {"REGION", "AMOUNT"}


def test_forecast_rows_need_every_input(spark):
    cfg = features.build_config(catalog.VISITOR_MODEL)
    day = spark.sql("select date'2024-01-06' as FULL_DATE, 1 as IS_WEEKEND")
    with pytest.raises(ValueError, match="is_holiday"):
        features.future_features(day, cfg, "FULL_DATE", ["day_sin", "is_holiday"])
    made = features.future_features(day.withColumn("IS_HOLIDAY", F.lit(1)), cfg, "FULL_DATE", ["day_sin", "is_holiday", "day_5"]).first()
    assert made["day_5"] == 1.0 and made["is_holiday"] == 1 and abs(made["day_sin"] + 0.9749279) < 1e-6


def test_nothing_is_cut(spark):
    points = "\n".join(f"{i}. point number {i}" for i in range(1, 12))
    row = spark.createDataFrame([(points, "$1 " + " ".join(f"€{i}" for i in range(1, 9)))], "t string, m string").select(
        text.key_points(F.col("t")).alias("p"), text.price_mentions(F.col("m")).alias("m")).first()
    assert len(row["p"]) == 11 and len(row["m"]) == 9
