"""Swaps that fail are finished, epochs are applied once, late events are added and counted; sketches."""

import random

import pytest
from pyspark.sql import functions as F

from piste.operators import incremental as INC
from piste.operators import sketches as SK
from piste.streaming import facts as SF


def _rows(spark, rows):
    return spark.createDataFrame(rows, "k string, month string, v int")


def _read(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(path).select("k", "month", "v").collect())


@pytest.mark.parametrize("partition", ["month", None])
def test_a_swap_that_fails_half_way_is_finished_by_the_next_load(spark, scratch, monkeypatch, partition):
    target = f"{scratch}/t"
    base = [(f"k{i}", f"m{i % 3}", i) for i in range(30)]
    INC.upsert(spark, _rows(spark, base), target, "k", partition_col=partition)
    change = [("k0", "m1", 100), ("k4", "m1", 104), ("new", "m2", 7)]
    want = sorted([r for r in base if r[0] not in ("k0", "k4")] + change)

    def half(spark_, target_, plan):
        if partition:  # the overwrite has removed a partition and not yet filled it
            INC.delete_path(spark, f"{target}/month=m1")
        else:
            INC.delete_path(spark, target)
        raise OSError("executor store went away")

    real = INC._swap
    monkeypatch.setattr(INC, "_swap", half)
    with pytest.raises(OSError):
        INC.upsert(spark, _rows(spark, change), target, "k", partition_col=partition, epoch=5)
    monkeypatch.setattr(INC, "_swap", real)
    assert not INC.committed(spark, target, 5)
    assert INC.recover(spark, target) and INC.committed(spark, target, 5) and not INC.recover(spark, target)
    assert _read(spark, target) == want
    again = INC.upsert(spark, _rows(spark, [("k9", "m0", -1)]), target, "k", partition_col=partition, epoch=5)
    assert again["mode"] == "skipped" and _read(spark, target) == want


def test_rows_in_the_null_partition_are_superseded(spark, scratch):
    target = f"{scratch}/t"
    INC.upsert(spark, _rows(spark, [("a", None, 1), ("b", None, 2), ("c", "m", 3)]), target, "k", partition_col="month")
    INC.upsert(spark, _rows(spark, [("a", "m", 9)]), target, "k", partition_col="month")
    assert sorted(r.k + str(r.v) for r in spark.read.parquet(target).collect()) == ["a9", "b2", "c3"]


def test_a_stream_that_fails_between_swap_and_commit_equals_a_full_build(spark, scratch, monkeypatch):
    for k in range(4):
        _rows(spark, [(f"k{i}", f"m{i % 2}", 10 * k + i) for i in range(k, k + 5)]).coalesce(1).write.mode("append").parquet(f"{scratch}/in")
    schema = spark.read.parquet(f"{scratch}/in").schema
    failed = []

    def sink(batch, epoch):
        SF.upsert_batch(f"{scratch}/out", ["k"], "month")(batch, epoch)
        if epoch == 2 and not failed:
            failed.append(epoch)
            raise RuntimeError("driver lost before the epoch's commit")

    def run():
        q = (SF.file_stream(spark, f"{scratch}/in", schema, max_files_per_trigger=1).writeStream.foreachBatch(sink)
             .option("checkpointLocation", f"{scratch}/ckpt").trigger(availableNow=True).start())
        q.awaitTermination()

    with pytest.raises(Exception):
        run()
    seen = []
    real = SF.upsert
    monkeypatch.setattr(SF, "upsert", lambda *a, **kw: seen.append(real(*a, **kw)["mode"]))
    run()
    assert failed == [2] and seen[0] == "skipped"
    want = {}
    for k in range(4):
        want |= {f"k{i}": 10 * k + i for i in range(k, k + 5)}
    assert {r.k: r.v for r in spark.read.parquet(f"{scratch}/out").collect()} == want


def test_late_events_are_added_once_and_counted(spark, scratch, monkeypatch):
    rng = random.Random(1)
    events = [(i, f"2024-01-{1 + i // 24:02d} {i % 24:02d}:{rng.randrange(60):02d}:00", rng.choice("ab"), float(i % 7)) for i in range(96)]
    events += rng.sample(events, 20)
    make = lambda rows: spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz"))
    for part in range(3, -1, -1):
        make([e for e in events if e[0] // 24 == part]).coalesce(1).write.mode("append").parquet(f"{scratch}/in")
    make([(0, events[0][1], events[0][2], events[0][3]), (500, None, "a", 1.0)]).coalesce(1).write.mode("append").parquet(f"{scratch}/in")
    sink, failed = SF.merge_hours(f"{scratch}/hours", "ts", "event_id", "event_type", "value", "2 hours"), []

    def failing(batch, epoch):
        sink(batch, epoch)
        if epoch == 1 and not failed:
            failed.append(1)
            raise RuntimeError("lost")

    def run():
        q = (SF.file_stream(spark, f"{scratch}/in", make([]).schema, max_files_per_trigger=1).writeStream.foreachBatch(failing)
             .option("checkpointLocation", f"{scratch}/ckpt").trigger(availableNow=True).start())
        q.awaitTermination()

    with pytest.raises(Exception):
        run()
    run()
    got = {(str(r.window_start), r.event_type): (r.events, r.value_sum, r.late_events) for r in SF.merged_hours(spark, f"{scratch}/hours", "event_type").collect()}
    want = {}
    for i, ts, kind, value in {e[0]: e for e in events}.values():
        n, s, late = want.get((ts[:13] + ":00:00", kind), (0, 0.0, 0))
        want[ts[:13] + ":00:00", kind] = (n + 1, s + value, late + (i < 72))
    assert got == want


def test_merged_sketches_keep_to_their_bound(spark):
    rng = random.Random(3)
    values = [rng.lognormvariate(0, 2) for _ in range(30_000)]
    rows = [(i % 30, "hot" if i % 3 else "rare", v) for i, v in enumerate(values)] + [(1, "hot", None), (99, "none", None)]
    facts = spark.createDataFrame(rows, "day int, slice string, v double")
    daily = SK.sketched(facts, ["day", "slice"], "v", 256)
    assert daily.count() == 30 and daily.where("slice = 'none'").count() == 0
    asked = SK.merged(daily, "slice").select("slice", "values", SK.quantile("sketch", 0.95).alias("p"))
    ok = {r["slice"]: r["within"] for r in SK.within_bound(facts, ["slice"], "v", asked, "p", 0.95, SK.rank_bound(256)).collect()}
    assert ok == {"hot": True, "rare": True}
    wrong = asked.withColumn("p", F.col("p") * 0)
    assert not any(r["within"] for r in SK.within_bound(facts, ["slice"], "v", wrong, "p", 0.95, SK.rank_bound(256)).collect())
