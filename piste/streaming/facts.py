"""The incremental models as Structured Streaming jobs.

* T01 ``stream_fact``: file-source stream -> staging/fact builder -> ``foreachBatch``
  upsert into a parquet fact (same upsert as I03).  The checkpoint replaces the
  reference's ``max(ts)`` probe: files already processed are never re-read, and late
  rows are not lost (defect B16 does not apply).  ``trigger(availableNow=True)`` runs a
  batch-style catch-up and stops.
* T02 ``dedup_within_watermark``: drop repeated keys among rows within the watermark.
* T03 ``hourly_load``: tumbling one-hour windows per key with a watermark, emitted in
  update mode and upserted by (window, key) so the sink converges to the final counts.
* T02/T03 ``merge_hours``: the same load for events of any lateness.  Every micro-batch leaves partial
  sums per hour and the keys that it counted; hours are the sums over all epochs, so an
  event past the watermark is added (and counted as late), never dropped.
* T04 ``enrich_with_current``: stream-static left join with the current dimension rows.

Checkpoints live under the shared ``spark.checkpoint.dir`` (see piste.session).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from piste.operators.incremental import delete_path, path_exists, upsert


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A table as a file stream, stored as one file or as a folder of part files."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return file_stream(spark, path, schema, None, max_files_per_trigger)
    return file_stream(spark, sf_dir, schema, f"{name}.parquet", max_files_per_trigger)


def file_stream(spark: SparkSession, src_dir: str, schema, glob: str | None = None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format("parquet")
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(src_dir)


def upsert_batch(target_path: str, keys: list[str], partition_col: str | None = None,
                 order_col: str | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: upsert each micro-batch on ``keys`` (I03 machinery).

    The epoch is noted in the target's ledger: an epoch that failed between the swap and the
    stream's own commit is finished and not applied again.  With
    ``partition_col`` only the partitions a batch touches are rewritten, so an epoch
    costs the size of its partitions, not of the whole target.
    """
    def write(batch: DataFrame, epoch_id: int) -> None:
        upsert(batch.sparkSession, batch, target_path, keys, order_col, partition_col, epoch=epoch_id)
    return write


def stream_fact(stream: DataFrame, build: Callable[[DataFrame], DataFrame], target_path: str, keys: list[str],
                checkpoint: str, available_now: bool = True, partition_col: str | None = None) -> StreamingQuery:
    """Run ``build`` over each micro-batch and upsert the result on ``keys``."""
    w = build(stream).writeStream.foreachBatch(upsert_batch(target_path, keys, partition_col)).option(
        "checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def event_time(stream: DataFrame, ts_col: str) -> DataFrame:
    """Watermarks need TIMESTAMP (session-zone) event time; NTZ columns are cast."""
    if dict(stream.dtypes).get(ts_col) == "timestamp_ntz":
        stream = stream.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
    return stream


def dedup_within_watermark(stream: DataFrame, ts_col: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Keys repeated within ``delay`` of event time are dropped (bounded state)."""
    return event_time(stream, ts_col).withWatermark(ts_col, delay).dropDuplicatesWithinWatermark(keys)


def hourly_load(stream: DataFrame, ts_col: str, key: str, value: str, delay: str | None = "1 hour") -> DataFrame:
    """Per (hour window, key): event count and value sum.

    ``delay=None`` reuses a watermark already defined upstream (e.g. by T02).
    """
    s = event_time(stream, ts_col)
    if delay is not None:
        s = s.withWatermark(ts_col, delay)
    g = s.groupBy(F.window(ts_col, "1 hour"), F.col(key))
    agg = g.agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("value_sum"))
    # back to wall-clock (NTZ) so results do not depend on the session time zone
    return agg.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window.end").cast("timestamp_ntz").alias("window_end"), key, "events", "value_sum")


HOUR = "window_start"


def merge_hours(root: str, ts_col: str, event_key: str, key: str, value: str, delay: str = "1 hour") -> Callable[[DataFrame, int], None]:
    """foreachBatch sink of the hourly load for events of any lateness.

    An epoch writes three folders, each complete or absent: ``sums`` (hour, key, events, value_sum,
    late_events), ``keys`` (event key, event time, by day) of the events it counted, and their
    ``newest`` event time.  An event is
    counted once: within the batch by its key, and against the epochs before it by the keys of
    the days that the batch touches, ``delay`` wider, as repeats stand at most that far apart.  An
    event is late if its hour ended before the greatest event time of earlier epochs less
    ``delay``.  A batch that is run again overwrites its own folders with the same rows.
    """
    gap = F.expr(f"INTERVAL {delay}")

    def write(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        t = F.col(ts_col).cast("timestamp_ntz")
        rows = batch.select(F.col(event_key).alias("event"), t.alias("at"), F.col(key).alias("key"), F.col(value).alias("value"))
        earliest = F.row_number().over(Window.partitionBy("event").orderBy("at", "key", "value"))
        rows = rows.filter("at is not null").withColumn("__n", earliest).filter("__n = 1").drop("__n")
        mark = None
        if path_exists(spark, f"{root}/keys"):
            # the folder of a failed try of this epoch is not looked at, and written anew below
            before = F.col("epoch") < epoch_id
            mark = spark.read.schema("at timestamp_ntz, epoch bigint").parquet(f"{root}/newest").where(before).agg(F.max("at")).first()[0]
            seen = spark.read.schema("event string, at timestamp_ntz, epoch bigint, day date").parquet(f"{root}/keys").where(before)
            days = rows.select(F.explode(F.sequence((F.col("at") - gap).cast("date"), (F.col("at") + gap).cast("date"))).alias("day")).distinct()
            near = seen.join(days, "day", "left_semi").select(F.col("event").alias("__event"), F.col("at").alias("__at"))
            same = (F.col("event").cast("string") == F.col("__event")) & F.col("at").between(F.col("__at") - gap, F.col("__at") + gap)
            rows = rows.join(near, same, "left_anti")
        counted = f"{root}/rows/epoch={epoch_id}"
        rows.write.mode("overwrite").parquet(counted)
        rows = spark.read.schema(rows.schema).parquet(counted)
        hour = F.date_trunc("hour", "at").cast("timestamp_ntz")
        late = F.lit(False) if mark is None else hour + F.expr("INTERVAL 1 HOUR") <= F.lit(str(mark)).cast("timestamp_ntz") - gap
        sums = rows.groupBy(hour.alias(HOUR), F.col("key").alias(key)).agg(
            F.count(F.lit(1)).alias("events"), F.sum("value").alias("value_sum"), F.sum(late.cast("long")).alias("late_events"))
        sums.write.mode("overwrite").parquet(f"{root}/sums/epoch={epoch_id}")
        rows.agg(F.max("at").alias("at")).write.mode("overwrite").parquet(f"{root}/newest/epoch={epoch_id}")
        rows.select(F.col("event").cast("string").alias("event"), "at", F.col("at").cast("date").alias("day")).write.mode("overwrite").partitionBy(
            "day").parquet(f"{root}/keys/epoch={epoch_id}")
        delete_path(spark, counted)
    return write


def merged_hours(spark: SparkSession, root: str, key: str) -> DataFrame:
    """The hours of all epochs: (window_start, key, events, value_sum, late_events)."""
    sums = spark.read.parquet(f"{root}/sums")
    return sums.groupBy(HOUR, key).agg(*[F.sum(c).alias(c) for c in ("events", "value_sum", "late_events")])


def enrich_with_current(stream: DataFrame, dim: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Stream-static left join with the current version of a dimension."""
    d = dim.filter(F.col("is_current")) if "is_current" in dim.columns else dim
    return stream.join(d.select(key, *cols), key, "left")
