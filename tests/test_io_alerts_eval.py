import datetime as dt

import pytest
from pyspark.sql import functions as F

from piste.operators import alerts as AL
from piste.operators import evaluation as EV
from piste.sources import io as IO

SCHEMA = "id int, name string, amount double"


def _write_text(spark, path, lines):
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)


def test_csv_strict_and_tolerant(spark, scratch):
    good, bad = f"{scratch}/good", f"{scratch}/bad"
    _write_text(spark, good, ["id,name,amount", '1,"a, b",2.5', "2,,3"])
    rows = IO.read_csv_strict(spark, good, SCHEMA).orderBy("id").collect()
    assert [(r.id, r.name, r.amount) for r in rows] == [(1, "a, b", 2.5), (2, None, 3.0)]
    _write_text(spark, bad, ["id,name,amount", "1,x,2.5", "oops,y,zz"])
    with pytest.raises(Exception):
        IO.read_csv_strict(spark, bad, SCHEMA).collect()
    kept = IO.read_csv_tolerant(spark, bad, IO.StructType.fromJson(
        spark.createDataFrame([], SCHEMA).schema.jsonValue()), reject_path=f"{scratch}/rejects")
    assert [r.id for r in kept.collect()] == [1]
    assert [r._rejected_record for r in spark.read.json(f"{scratch}/rejects").select("_rejected_record", "name").collect()] == ["oops,y,zz"]


def test_sinks_guard_counts(spark, scratch):
    df = spark.createDataFrame([(1, dt.date(2024, 1, 1)), (2, dt.date(2024, 1, 2))], "id int, d date")
    IO.append_day(df, f"{scratch}/daily", "d")
    IO.append_day(df.limit(1), f"{scratch}/daily", "d")
    assert spark.read.parquet(f"{scratch}/daily").count() == 3
    IO.export_csv_gz(df, f"{scratch}/gz")
    assert spark.read.option("header", True).csv(f"{scratch}/gz").count() == 2
    incoming = spark.createDataFrame([(3, dt.date(2024, 1, 2)), (4, dt.date(2024, 1, 3))], "id int, d date")
    assert [r.id for r in IO.new_dates_only(incoming, "d", [df], ["d"]).collect()] == [4]
    assert IO.new_dates_only(incoming, "d", [df], ["d"], force=True).count() == 2
    counts = {r.table_name: r.row_count for r in IO.row_counts({"a": df, "b": incoming.limit(1)}).collect()}
    assert counts == {"a": 2, "b": 1}
    fresh = IO.freshness({"a": (df, "d")}).first()
    assert fresh.latest_date == dt.date(2024, 1, 2)


def test_alert_log_and_subscriptions(spark):
    alerts = spark.createDataFrame(
        [("1", "x@r.com", "Daily revenue?", "daily", True, None), ("2", "x@r.com", "Lift waits?", "weekly", True, None)],
        "alert_id string, recipient_email string, question string, frequency string, is_active boolean, "
        "last_sent_at timestamp_ntz")
    results = spark.createDataFrame([("1", "Daily revenue?", "r" * 5000, None), ("2", "Lift waits?", None, "e" * 900)],
                                    "alert_id string, question string, response string, error string")
    log = AL.run_log(results, "2024-03-10 07:00:00")
    rows = {r.alert_id: r for r in log.collect()}
    assert rows["1"].status == "success" and len(rows["1"].response) == 5000
    assert rows["2"].status == "failed" and len(rows["2"].error_message) == 900
    sent = {r.alert_id: r.last_sent_at for r in AL.mark_sent(alerts, log).collect()}
    assert sent["1"] == dt.datetime(2024, 3, 10, 7) and sent["2"] is None
    subs = {r.alert_id: r.times_sent for r in AL.subscriptions(alerts, log, "x@r.com").collect()}
    assert subs == {"1": 1, "2": 0}
    after = {r.alert_id: r.is_active for r in AL.cancel_matching(alerts, "x@r.com", "lift").collect()}
    assert after == {"1": True, "2": False}


def test_evaluation_rollup_and_golden_versions(spark):
    res = spark.createDataFrame(
        [("a", "x" * 60, "Ops", ["OpsTool"], "SELECT COUNT(*) FROM T", True, "SELECT COUNT(*) FROM T"),
         ("a", "short", None, [], None, None, None)],
        "agent string, answer string, expected_tool string, tools array<string>, sql string, sql_valid boolean, "
        "validation_query string")
    r = EV.rollup(EV.score_results(res), "agent").first()
    assert (r.goal, r.plan, r.questions) == (0.5, 0.75, 2)
    assert abs(r.action - 0.5) < 1e-9 and abs(r.overall - (0.5 + 0.75 + 0.5) / 3) < 1e-9
    golden = spark.createDataFrame([(1, "ops", "v1", "in_scope"), (2, "ops", "v2", "in_scope")],
                                   "id int, agent_name string, version string, question_type string")
    new = spark.createDataFrame([(3, "ops", "v2", "negative")], "id int, agent_name string, version string, question_type string")
    out = EV.replace_version(golden, new)
    assert sorted(r.id for r in out.collect()) == [1, 3]
    assert EV.golden_summary(out).count() == 2


def test_declared_raw_schemas(spark, scratch):
    from piste.sources import schemas as S

    assert len(S.RAW_DDL) == 25
    assert S.schema("ticket_sales")["purchase_amount"].dataType.simpleString() == "decimal(10,2)"
    spark.createDataFrame([("s1", "c1", 12.5)], "sale_id string, customer_id string, purchase_amount double").select(
        "sale_id", "customer_id", F.col("purchase_amount").cast("decimal(10,2)")).write.parquet(f"{scratch}/ticket_sales")
    df = S.read_raw(spark, scratch, "ticket_sales")
    assert df.schema == S.schema("ticket_sales")
    assert df.first().sale_id == "s1"


def test_json_documents_seed_and_exports(spark, scratch):
    import json
    import os

    os.makedirs(f"{scratch}/docs", exist_ok=True)
    with open(f"{scratch}/docs/d.json", "w") as fh:
        json.dump([{"doc_id": "1", "doc_type": "policy", "title": "Lift hours", "content": "Open 9-4"},
                   {"doc_id": "2", "doc_type": "faq", "title": "Parking", "content": "Lot A"}], fh, indent=2)
    IO.load_documents_json(spark, f"{scratch}/docs", f"{scratch}/docs_table")
    assert spark.read.parquet(f"{scratch}/docs_table").count() == 2
    IO.load_documents_json(spark, f"{scratch}/docs", f"{scratch}/docs_table")      # truncate-and-load
    assert spark.read.parquet(f"{scratch}/docs_table").count() == 2
    _write_text(spark, f"{scratch}/seed", ["id,name,amount", "1,a,1.0", "2,b,2.0"])
    seed = IO.read_seed(spark, f"{scratch}/seed", SCHEMA)
    IO.overwrite(seed, f"{scratch}/seed_copy")
    IO.export_csv(seed, f"{scratch}/seed_csv")
    assert spark.read.parquet(f"{scratch}/seed_copy").count() == 2
    assert spark.read.option("header", True).csv(f"{scratch}/seed_csv").count() == 2
    assert IO.sample_rows(seed, 1.0).count() == 2
