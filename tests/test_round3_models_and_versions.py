"""Snapshots out of order, refit on all rows, band tables as data, a written prediction log."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from piste.operators import dims as D
from piste.operators import forecast as FC
from piste.operators import monitoring as MO
from piste.plans import catalog
from tests.conftest import SF_SMALL

OPEN = "9999-12-31"


def versions(spark, rows):
    df = spark.createDataFrame(rows, "id string, tier string, city string, a string, b string, is_current boolean")
    ts = lambda c: F.col(c).cast("timestamp_ntz")
    return df.select("id", "tier", "city", ts("a").alias("valid_from"), ts("b").alias("valid_to"), "is_current")


def merge(spark, current, snapshot, ts):
    out = D.scd2_merge(current, spark.createDataFrame(snapshot, "id string, tier string"), "id", ["tier"], f"{ts} 00:00:00")
    return out, sorted((r.id, r.tier, r.city, str(r.valid_from)[:10], str(r.valid_to)[:10], r.is_current) for r in out.collect())


def test_an_earlier_snapshot_splits_the_version_that_held_then(spark):
    history = versions(spark, [("a", "x", "c1", "2020-01-01", "2021-01-01", False), ("a", "y", "c2", "2021-01-01", OPEN, True),
                               ("b", "x", "c3", "2020-01-01", OPEN, True), ("gone", None, "c4", "2020-01-01", OPEN, True)])
    out, got = merge(spark, history, [("a", "z"), ("b", "x"), ("new", None)], "2020-06-01")
    assert got == [("a", "x", "c1", "2020-01-01", "2020-06-01", False), ("a", "y", "c2", "2021-01-01", OPEN, True),
                   ("a", "z", "c1", "2020-06-01", "2021-01-01", False), ("b", "x", "c3", "2020-01-01", OPEN, True),
                   ("gone", None, "c4", "2020-01-01", OPEN, True), ("new", None, None, "2020-06-01", OPEN, True)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("Union") == 0
    # again, at the same time: nothing new but the corrected tier
    _, again = merge(spark, out, [("a", "w"), ("b", "x"), ("new", None)], "2020-06-01")
    key = lambda r: (r[0], r[3])
    assert sorted(again, key=key) == sorted(((r[0], "w" if r[:2] == ("a", "z") else r[1], *r[2:]) for r in got), key=key)


def test_a_snapshot_before_the_first_version(spark):
    history = versions(spark, [("a", "x", "c1", "2020-01-01", OPEN, True), ("b", "x", "c2", "2020-01-01", OPEN, True)])
    _, got = merge(spark, history, [("a", "w"), ("b", "x")], "2019-01-01")
    assert got == [("a", "w", "c1", "2019-01-01", "2020-01-01", False), ("a", "x", "c1", "2020-01-01", OPEN, True),
                   ("b", "x", "c2", "2019-01-01", OPEN, True)]


def test_snapshots_in_any_order_give_one_history(spark):
    first = versions(spark, [("a", "1", None, "2020-01-01", OPEN, True)])
    snaps = [("2020-03-01", "2"), ("2020-05-01", "3"), ("2020-07-01", "2")]
    results = set()
    for order in ([0, 1, 2], [2, 1, 0], [1, 0, 2]):
        now = first
        for k in order:
            now, got = merge(spark, now, [("a", snaps[k][1])], snaps[k][0])
        results.add(tuple(got))
    assert results == {(("a", "1", None, "2020-01-01", "2020-03-01", False), ("a", "2", None, "2020-03-01", "2020-05-01", False),
                        ("a", "2", None, "2020-07-01", OPEN, True), ("a", "3", None, "2020-05-01", "2020-07-01", False))}


def test_refit_takes_all_rows_and_the_best_iteration(spark):
    got = {r["fit"]: r for r in catalog.REGISTRY["p14_refit_on_all_rows"](spark, SF_SMALL).collect()}
    fit = catalog._fit(spark, SF_SMALL)
    rows = fit["panel"].count()
    assert got["final"]["trees"] == got["validation"]["trees"] >= 1 and got["final"]["fitted_rows"] == rows
    assert got["validation"]["validation_rows"] > 0 and got["validation"]["fitted_rows"] + got["validation"]["validation_rows"] < rows
    again = FC.refit_all(fit["panel"], fit["validated"], fit["features"], "UNIQUE_VISITORS")
    trees = lambda m: m.stages[-1].toDebugString.split("\n", 1)[1]  # noqa: E731  (without the model's own name)
    assert trees(again) == trees(fit["final"])


def bands(spark, rows):
    return spark.createDataFrame(rows, "level string, min_visitors long, max_visitors long, crew string")


def test_bands_are_data_and_looked_up_by_value(spark):
    table = bands(spark, [("b", 10, 20, "2"), ("a", 0, 10, "1"), ("c", 20, None, "3")])
    df = spark.createDataFrame([(0.0,), (9.9,), (10.0,), (19.99,), (20.0,), (1e9,), (None,), (-1.0,)], "v double")
    got = [(r["v"], r["level"], r["crew"]) for r in FC.assign_bands(df, "v", table).collect()]
    assert got == [(0.0, "a", "1"), (9.9, "a", "1"), (10.0, "b", "2"), (19.99, "b", "2"), (20.0, "c", "3"), (1e9, "c", "3"), (None, None, None), (-1.0, None, None)]
    many = bands(spark, [(str(i), i, i + 1 if i < 499 else None, "") for i in range(500)])
    assert [r["level"] for r in FC.assign_bands(df.where("v between 0 and 30"), "v", many).collect()] == ["0", "9", "10", "19", "20"]
    default = FC.assign_bands(spark.createDataFrame([(499,), (500,), (3000,)], "v long"), "v", FC.default_bands(spark))
    assert [r["level"] for r in default.collect()] == ["minimal", "light", "peak"]


@pytest.mark.parametrize("rows", [
    [], [("a", 0, 10, ""), ("b", 11, None, "")], [("a", 0, 10, ""), ("b", 9, None, "")], [("a", 1, None, "")], [("a", 0, 10, "")],
    [("a", 0, None, ""), ("b", 5, None, "")], [("a", 0, 0, ""), ("b", 0, None, "")]])
def test_band_tables_with_gaps_overlaps_or_ends_are_refused(spark, rows):
    with pytest.raises(ValueError):
        FC.checked_bands(bands(spark, rows))


def test_predictions_are_appended_and_backfilled_once(spark, scratch):
    path = f"{scratch}/log"

    def run(name, days):
        rows = [("s", dt.date(2021, 1, d), float(d), 1, 1, False, 1.0, 1.0, 1.0) for d in days]
        df = spark.createDataFrame(rows, "ent string, d date, p double, day_of_week int, month int, is_weekend boolean, lag_7 double, lag_14 double, rolling_7_mean double")
        return MO.log_from_predictions(df, "ent", "d", "p", "M", F.lit("v"), F.lit(name))

    MO.append_predictions(run("r1", [1, 2, 3]), path)
    MO.append_predictions(run("r1", [1, 2, 3]).unionByName(run("r2", [3, 4])), path)
    log = lambda: sorted((r.run_id, r.forecast_date.day, r.actual_visitors) for r in spark.read.parquet(path).collect())
    assert log() == [("r1", 1, None), ("r1", 2, None), ("r1", 3, None), ("r2", 3, None), ("r2", 4, None)]
    actuals = spark.createDataFrame([("s", dt.date(2021, 1, 1), 11), ("s", dt.date(2021, 1, 3), 13)], "series string, forecast_date date, actual long")
    for _ in range(2):
        MO.backfill_log(spark, path, actuals, "2021-01-04")
        assert log() == [("r1", 1, 11), ("r1", 2, 0), ("r1", 3, 13), ("r2", 3, 13), ("r2", 4, None)]


def test_monitoring_queries_share_one_log(spark):
    catalog._LOGS.clear()
    paths = set()
    for name in ("o03_prediction_errors", "o08_metrics_by_version", "o10_bias_check", "o01_prediction_log_features"):
        files = catalog.REGISTRY[name](spark, SF_SMALL).inputFiles()
        paths |= {f.split("/predictions/")[0] for f in files}
    assert len(paths) == 1
