import datetime as dt

from pyspark.sql import functions as F

from piste.operators import quality as Q
from piste.operators.incremental import incremental_load


def _src(spark, rows):
    return spark.createDataFrame(rows, "id string, v int, ts string").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")).withColumn("month", F.date_format("ts", "yyyy-MM"))


def test_incremental_equals_full_refresh(spark, scratch):
    rows = [("a", 1, "2021-01-01 10:00:00"), ("b", 2, "2021-01-02 10:00:00"), ("c", 3, "2021-02-01 10:00:00"),
            ("d", 4, "2021-02-03 10:00:00")]
    src = _src(spark, rows)
    kw = dict(unique_key="id", watermark_col="ts", partition_col="month", cluster_col="ts")
    incremental_load(spark, lambda s: s, src.filter(F.col("ts") < "2021-02-01"), f"{scratch}/inc", **kw)
    rep = incremental_load(spark, lambda s: s, src, f"{scratch}/inc", **kw)
    assert rep["mode"] == "incremental"
    got = sorted((r.id, r.v) for r in spark.read.parquet(f"{scratch}/inc").collect())
    assert got == [("a", 1), ("b", 2), ("c", 3), ("d", 4)]


def test_strict_high_water_mark_drops_late_rows_and_lookback_keeps_them(spark, scratch):
    first = _src(spark, [("a", 1, "2021-01-05 00:00:00")])
    incremental_load(spark, lambda s: s, first, f"{scratch}/t", "id", "ts")
    late = _src(spark, [("a", 9, "2021-01-05 00:00:00"), ("b", 2, "2021-01-04 00:00:00"),
                        ("c", 3, "2021-01-06 00:00:00")])
    incremental_load(spark, lambda s: s, late, f"{scratch}/t", "id", "ts")
    assert sorted((r.id, r.v) for r in spark.read.parquet(f"{scratch}/t").collect()) == [("a", 1), ("c", 3)]
    # re-reading a three-day window upserts the equal-timestamp row and keeps the late one
    incremental_load(spark, lambda s: s, late, f"{scratch}/t", "id", "ts", lookback=F.expr("INTERVAL 3 DAYS"))
    assert sorted((r.id, r.v) for r in spark.read.parquet(f"{scratch}/t").collect()) == [
        ("a", 9), ("b", 2), ("c", 3)]


def test_schema_change_append_new_columns(spark, scratch):
    incremental_load(spark, lambda s: s, _src(spark, [("a", 1, "2021-01-01 00:00:00")]), f"{scratch}/s", "id", "ts")
    new = _src(spark, [("b", 2, "2021-01-02 00:00:00")]).withColumn("extra", F.lit("x"))
    rep = incremental_load(spark, lambda s: s, new, f"{scratch}/s", "id", "ts")
    assert rep["schema_changed"]
    rows = {r.id: r.extra for r in spark.read.parquet(f"{scratch}/s").collect()}
    assert rows == {"a": None, "b": "x"}


def test_quality_checks(spark):
    child = spark.createDataFrame([(1, "x", "online"), (1, None, "fax"), (2, "y", None), (3, "q", "kiosk")],
                                  "id int, fk string, channel string")
    parent = spark.createDataFrame([("x",), ("y",)], "pk string")
    assert Q.unique(child, "id").count() == 1
    assert Q.not_null(child, "fk").count() == 1
    assert [r.fk for r in Q.relationships(child, "fk", parent, "pk").collect()] == ["q"]
    assert Q.accepted_values(child, "channel", ["online", "kiosk"]).count() == 1
    suite = Q.run_suite({"c": child, "p": parent}, [
        Q.Check("u", "unique", "c", "id"), Q.Check("n", "not_null", "c", "fk"),
        Q.Check("r", "relationships", "c", "fk", "p", "pk"),
        Q.Check("a", "accepted_values", "c", "channel", values=("online", "kiosk", "fax"))])
    got = {r.check_name: (r.failures, r.status) for r in suite.collect()}
    assert got == {"u": (1, "fail"), "n": (1, "fail"), "r": (1, "fail"), "a": (0, "pass")}
    prof = Q.overlap_profile(spark.createDataFrame([(dt.date(2021, 1, 1),), (dt.date(2021, 1, 2),)], "d date"), "d",
                             spark.createDataFrame([(dt.date(2021, 1, 2),), (dt.date(2021, 1, 3),)], "d date"), "d")
    r = prof.first()
    assert (r.left_days, r.right_days, r.overlap_days) == (2, 2, 1)


def test_sync_all_columns_full_refresh_and_stored_failures(spark, scratch):
    base = _src(spark, [("a", 1, "2021-01-01 00:00:00")]).withColumn("old", F.lit("o"))
    incremental_load(spark, lambda s: s, base, f"{scratch}/y", "id", "ts")
    new = _src(spark, [("b", 2, "2021-01-02 00:00:00")])
    incremental_load(spark, lambda s: s, new, f"{scratch}/y", "id", "ts", on_schema_change="sync_all_columns")
    out = spark.read.parquet(f"{scratch}/y")
    assert "old" not in out.columns and sorted(r.id for r in out.collect()) == ["a", "b"]
    rep = incremental_load(spark, lambda s: s, new, f"{scratch}/y", "id", "ts", full_refresh=True)
    assert rep["mode"] == "full" and spark.read.parquet(f"{scratch}/y").count() == 1
    Q.store_failures(Q.not_null(base.withColumn("v", F.lit(None).cast("int")), "v"), f"{scratch}/failures")
    assert spark.read.parquet(f"{scratch}/failures").count() == 1


def test_failing_rows_are_counted_by_value(spark):
    from piste.operators import quality as Q

    child = spark.createDataFrame([(1, "a"), (1, "b"), (2, "x"), (None, "x"), (9, None)], "k int, v string")
    tables = {"child": child, "parent": spark.createDataFrame([(1,), (2,)], "p int")}
    checks = [Q.Check("u", "unique", "child", "k"), Q.Check("n", "not_null", "child", "k"), Q.Check("a", "accepted_values", "child", "v", values=("a", "b")),
              Q.Check("r", "relationships", "child", "k", "parent", "p")]
    got = sorted((r["check_name"], r["value"], r["n_records"]) for r in Q.failing_rows(tables, checks).collect())
    assert got == [("a", "x", 2), ("n", "", 1), ("r", "9", 1), ("u", "1", 2)]
