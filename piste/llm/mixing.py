"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight schedule w(t), linear between knots over training time t in
[0, 1].  Its integral G(t), scaled to the source's target, says how many of its words training
has asked for by time t; inverting that demand at a document's place in the source's supply
gives the document's training time.  Range-sorting by time gives the training order.

Supply: the documents of a source in hash order of doc_id (md5 bucket, then md5), and again from the start once all
are used, at most ``max_epochs`` times.  The copy at which demand ends is cut to what remains.

Null or empty texts have size 0, are never taken and have no position.  A null source is a
source of its own, last in order.  Rows with equal doc_id and size tie and are interchangeable.
No row is dropped from :func:`plan`; repeated rows are each a document; other columns, of any
name, are ignored; a text of any length is counted whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from piste.llm.common import staged

WORD = r"[^\x20\x09-\x0D]+"
#: Relative weight at the knots of [0, 1] (evenly spaced), by place of the source's weight:
#: heavy sources fade in, medium ones stay level, light ones fade out.
SCHEDULES = ((1.0, 2.0), (1.0, 1.0), (1.0, 1.5, 0.5))


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) -> with ``place`` in the list of weights and ``target``.

    A target is min(cap * size, level * weight) with one level for all, which is where resharing
    the excess by weight ends: sources sorted by cap / weight are at their cap up to the place
    from which the rest, shared by weight, stays below every further cap.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    s = sizes.withColumn("place", (F.row_number().over(order) - 1) % len(weights))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("place") + 1))
    s = s.withColumn("top", F.col("source_size") * cap).withColumn("ratio", F.col("top") / F.col("weight"))
    by = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before, rest, whole = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    s = s.withColumn("level", level).withColumn("rank", F.row_number().over(by))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("rank", "level"))).over(whole)["level"])
    target = F.least(F.col("top"), F.coalesce("level", "ratio") * F.col("weight"))
    return s.select("source", "source_size", "place", target.cast("double").alias("target"))


def _integral(knots: Sequence[float], t: float) -> float:
    """Integral of the piecewise linear schedule from 0 to t."""
    step, total = 1.0 / (len(knots) - 1), 0.0
    for k, (a, b) in enumerate(zip(knots, knots[1:])):
        x = min(max(t - k * step, 0.0), step)
        total += a * x + (b - a) / step * x * x / 2
    return total


def training_time(part: Column, knots: Sequence[float]) -> Column:
    """Time at which the demand of a schedule reaches ``part`` (0 to 1) of its whole."""
    step, whole, out = 1.0 / (len(knots) - 1), _integral(knots, 1.0), F.lit(1.0)
    need = part * whole
    for k in range(len(knots) - 2, -1, -1):
        at, a, slope = _integral(knots, k * step), knots[k], (knots[k + 1] - knots[k]) / step
        left = F.greatest(need - at, F.lit(0.0))
        x = left / a if slope == 0 else (F.sqrt(F.greatest(a * a + 2 * slope * left, F.lit(0.0))) - a) / slope
        out = F.when(need < _integral(knots, (k + 1) * step), F.least(F.lit(k * step) + x, F.lit(1.0))).otherwise(out)
    return out


def plan(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: int = 2,
         schedules: Sequence[Sequence[float]] = SCHEDULES, buckets: int = 4096) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, copies (the training
    time of every copy taken, with the words it takes).

    Supply order is the hash of doc_id.  Cumulative sizes come from two windows, one over the
    hash buckets of a source and one inside a bucket, so a source with a third of all rows is
    spread over all buckets.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    bucket = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % buckets
    base = staged(docs.select("doc_id", "source", word_count("text").alias("size"), key.alias("key")).withColumn("bucket", bucket), "sizes")
    filled = base.groupBy("source", "bucket").agg(F.sum("size").alias("filled"))
    goal = targets(filled.groupBy("source").agg(F.sum("filled").alias("source_size")), weights, share, cap)
    start = F.coalesce(F.sum("filled").over(
        Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = (filled.withColumn("ahead", start).alias("f")
             .join(goal.alias("g"), F.col("f.source").eqNullSafe(F.col("g.source")))
             .select("f.source", "f.bucket", "ahead", "source_size", "place", "target"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = (placed.alias("p").join(ahead.alias("a"), F.col("p.source").eqNullSafe(F.col("a.source"))
                                & (F.col("p.bucket") == F.col("a.bucket")))
         .select("doc_id", F.col("p.source").alias("source"), "size", "source_size", "place", "target",
                 (F.col("ahead") + F.col("before")).alias("at")))
    place, copies = F.element_at(F.array(*[F.lit(i % len(schedules)) for i in range(len(weights))]), F.col("place") + 1), []
    for epoch in range(cap):
        at = F.col("at") + epoch * F.col("source_size")
        words = F.least(F.col("size"), F.greatest(F.floor("target") - at, F.lit(0))).cast("long")
        part = F.try_divide(at.cast("double"), F.col("target"))
        time = F.lit(None).cast("double")
        for i, knots in enumerate(schedules):
            time = F.when(place == i, training_time(part, knots)).otherwise(time)
        copies.append(F.struct(F.lit(epoch).alias("epoch"), time.alias("position"), words.alias("words")))
    made = d.withColumn("copies", F.filter(F.array(*copies), lambda c: c["words"] > 0))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda n, c: n + c["words"])
    return made.withColumn("taken", taken).select("doc_id", "source", "size", "source_size", "target", "taken", "copies")


def laid_out(planned: DataFrame) -> DataFrame:
    """The plan's rows with ``position`` and ``again``, the training times of a document's first and
    second copy (null: not taken), range-sorted by position; documents not taken come last."""
    at = lambda i: F.get("copies", F.lit(i))["position"]
    rows = planned.withColumns({"position": at(0), "again": at(1)}).drop("copies")
    order = [F.col("position").asc_nulls_last(), F.col("doc_id")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def in_order(planned: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per copy that training takes, range-sorted by training time: position, doc_id,
    epoch, words."""
    rows = planned.select("doc_id", "source", F.explode("copies").alias("c")).select("c.position", "doc_id", "source", "c.epoch", "c.words")
    spread = rows.repartitionByRange(partitions, "position", "doc_id") if partitions else rows.repartitionByRange("position", "doc_id")
    return spread.sortWithinPartitions("position", "doc_id", "epoch")
