"""Hard-negative mining by threshold joins with a norm-bounded inverted index.

Entries become integers floor(256 x); a score is the integer inner product of an anchor and a row.
Two joins, each repeated at falling thresholds, find first the best rows of the anchor's own label
(its positives), then for every positive the best rows of other labels whose score lies in the window
from ``low`` to ``high`` per cent of the positive's.

A join at thresholds t works block by block.  The index of a block of rows has a posting list per
dimension, weak dimensions first.  A row is left out of the lists of its leading dimensions for as
long as its norm over them times the anchors' stays below t: a row that only shares those cannot
reach t.  Anchors accumulate partial scores over the lists from the last dimension down; after each
group of dimensions a row is dropped once its partial score plus the product of the remaining norms
is below t.  Survivors take their left-out dimensions from the row itself, so scores are exact.

The first threshold of an anchor is where a bounded sample of rows lets one expect four times the
rows asked for; anchors with unfilled windows come again with eight times as many expected, and in
the end with no threshold (or the window's lower end), where every row is considered.  So every
window is filled or holds all there is; nothing is capped.  A block leaves no more rows than are
asked for.

Rows with a null id, label or vector, with null or non-finite entries, entries of 2^45 or more in
magnitude, an empty vector or not the table's length (see ``vectors``) take no part.  Of several rows
under an id the one of least (label, vector) stands.  Where ``shift_every`` divides the id, the label
is first moved on by one, modulo ``labels``.  Equal scores go by id.  Scores past 2^53 are summed as
Python integers and end at the 64-bit limits.  Other columns are ignored; an empty table gives an
empty result; an anchor without positives has no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from piste.llm.common import least_by_hash, staged
from piste.llm.vectors import column, in_blocks, matrix, runs, usable

EXACT = float(1 << 53)
BOUND = 1 + 1e-9  # rounding of norms


class Index:
    """Posting lists of a block of integer rows for anchors with thresholds.

    Dimension j's list is the first ``ends[j]`` rows, rows being sorted by the number of their leading
    dimensions left out.
    """

    def __init__(self, x: np.ndarray, anchors: np.ndarray, limits: np.ndarray):
        self.dims = np.argsort((x * x).sum(0), kind="stable")
        x, anchors = x[:, self.dims], anchors[:, self.dims]
        norms = self.norms(x)
        if (limits > 0).all():
            worst = (self.norms(anchors) / limits[:, None]).max(0) * BOUND
            out = (norms * worst < 1).sum(1) - 1  # the empty prefix always passes
        else:
            out = np.zeros(len(x), np.int64)
        self.order = np.argsort(out, kind="stable")
        self.x, self.left_out, self.row_norms = x[self.order], out[self.order], norms[self.order]
        self.listed = np.where(np.arange(x.shape[1])[None] >= self.left_out[:, None], self.x, 0.0)
        self.ends = np.searchsorted(self.left_out, np.arange(x.shape[1]), "right")

    @staticmethod
    def norms(x: np.ndarray) -> np.ndarray:
        """Norm of every prefix, the empty one first."""
        return np.sqrt(np.concatenate([np.zeros((len(x), 1)), np.cumsum(x * x, 1)], 1))

    def reaching(self, anchors: np.ndarray, limits: np.ndarray, groups: int = 4):
        """For each anchor: places of the rows whose score reaches its limit, and the scores."""
        a = anchors[:, self.dims]
        norms, d = self.norms(a), a.shape[1]
        cuts = [d * g // groups for g in range(groups, -1, -1)]
        start, end = cuts[1], self.ends[d - 1]
        sums = a[:, start:] @ self.listed[:end, start:].T
        for i, limit in enumerate(limits):
            live, part, at = np.arange(end), sums[i], start
            for after in [*cuts[2:], None]:
                rest = np.maximum(self.left_out[live], at)
                keep = (part + norms[i, rest] * self.row_norms[live, rest]) * 1.0 + 1e-6 * abs(limit) >= limit if np.isfinite(limit) else slice(None)
                live, part = live[keep], part[keep]
                if after is None or not len(live):
                    break
                listed = live[: np.searchsorted(live, self.ends[at - 1])] if at else live[:0]
                part = part.copy()
                part[: len(listed)] += self.listed[listed, after:at] @ a[i, after:at]
                at = after
            own = np.arange(d)[None] < self.left_out[live][:, None]
            score = part + np.where(own, self.x[live], 0.0) @ a[i]
            ok = score >= limit
            yield self.order[live[ok]], score[ok]


def large(x: np.ndarray, anchors: np.ndarray) -> bool:
    """Whether a score, or a sum on the way to it, may pass the integers that doubles hold."""
    top = lambda m: np.sqrt((m * m).sum(1)).max(initial=0)
    return top(x) * top(anchors) >= EXACT


def scored(x: np.ndarray, anchors: np.ndarray, limits: np.ndarray):
    """For each anchor, places and integer scores of the rows that reach its limit."""
    if large(x, anchors):
        whole = np.array([[int(e) for e in r] for r in x], object).reshape(x.shape)
        for a, limit in zip(anchors, limits):
            score = whole @ np.array([int(e) for e in a], object)
            score = np.array([min(max(s, -(2**63)), 2**63 - 1) for s in score], object)
            ok = np.flatnonzero([s >= limit for s in score])
            yield ok, score[ok].astype(np.int64)
        return
    for ok, score in Index(x, anchors, limits).reaching(anchors, limits):
        yield ok, score.astype(np.int64)


def first_rows(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by id."""
    if len(score) > k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], -score[some]))[:k]]


FOUND = "anchor_id long, wanted long, vec_id long, score long"


def joined(asked: DataFrame, rows: DataFrame, blocks: int, k: int) -> DataFrame:
    """(anchor_id, wanted, vec_id, score): per block and window the ``k`` best rows.

    ``asked``: vec_id, label, x, t, windows (structs wanted, low, high; a null wanted asks for the
    anchor's own label).  Every anchor goes to every block of rows, and no pair leaves a task that is
    not among the ``k`` best of its window there.
    """
    window = "array<struct<wanted:bigint,low:bigint,high:bigint>>"
    mine = rows.select(F.expr(f"cast(pmod(xxhash64(vec_id), {blocks}) as int)").alias("block"), F.lit(0).alias("kind"), "vec_id", "label", "x",
                       F.lit(None).cast("double").alias("t"), F.lit(None).cast(window).alias("windows"))
    theirs = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "vec_id", "label", "x", "t",
                          F.col("windows").cast(window))

    def find(batches):
        block, held, x = None, [], None
        for (at, kind), part in runs(batches, "block", "kind"):
            if at != block:
                block, held, x = at, [], None
            if kind == 0:
                held.append(part)
                continue
            if not held:
                continue
            if x is None:
                table = pa.Table.from_batches(held)
                ids, labels, x = table["vec_id"].to_numpy(), table["label"].to_numpy(), matrix(table["x"])
                order = np.lexsort((*x.T[::-1], labels, ids))
                ids, labels, x = ids[order], labels[order], x[order]
                new = np.concatenate([[True], ids[1:] != ids[:-1]])
                ids, labels, x = ids[new], labels[new], x[new]
            for s in range(0, part.num_rows, 64):
                some = part.slice(s, 64)
                own, own_label = column(some, "vec_id").to_numpy(), column(some, "label").to_numpy()
                limits, windows = column(some, "t").to_numpy(zero_copy_only=False), column(some, "windows").to_pylist()
                out = []
                for i, (places, score) in enumerate(scored(x, matrix(column(some, "x")), limits)):
                    other = ids[places] != own[i]
                    same = labels[places] == own_label[i]
                    for w in windows[i]:
                        ok = other & same if w["wanted"] is None else other & ~same & (score >= w["low"]) & (score <= w["high"])
                        at_ = np.flatnonzero(ok)
                        best = at_[first_rows(score[at_], ids[places[at_]], k)]
                        out += [(int(own[i]), w["wanted"], int(ids[places[p]]), int(score[p])) for p in best]
                cols = list(zip(*out)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["anchor_id", "wanted", "vec_id", "score"])

    return in_blocks(mine.unionByName(theirs), ["block"], ["kind", "vec_id"]).mapInArrow(find, FOUND)


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def thresholds(asked: DataFrame, sample: pa.Table, expected: float) -> DataFrame:
    """``asked`` (vec_id, label, x, windows) with ``t``: the least, over an anchor's windows, of the score
    that so many rows of the sample in the window's reach have; no limit (or the window's lower
    end) where the sample holds fewer."""
    labels, x = sample["label"].to_numpy(), matrix(sample["x"])
    ids, at = sample["vec_id"].to_numpy(), max(0, round(expected) - 1)

    def low(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own, own_label, t = column(batch, "vec_id").to_numpy(), column(batch, "label").to_numpy(), []
            score = matrix(column(batch, "x")) @ x.T
            for i, windows in enumerate(column(batch, "windows").to_pylist()):
                limits, same = [], labels == own_label[i]
                for w in windows:
                    ok = same & (ids != own[i]) if w["wanted"] is None else ~same & (score[i] <= w["high"])
                    reach = score[i][ok]
                    limit = np.partition(reach, len(reach) - 1 - at)[len(reach) - 1 - at] if len(reach) > at else -np.inf
                    limits.append(float(limit) if w["wanted"] is None else max(float(limit), float(w["low"])))
                t.append(min(limits, default=np.inf))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(t, pa.float64())], names=[*batch.schema.names, "t"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema.fields)
    return asked.mapInArrow(low, f"{schema}, t double")


def filled(anchors: DataFrame, rows: DataFrame, sample: pa.Table, total: int, blocks: int, k: int) -> DataFrame:
    """(anchor_id, wanted, vec_id, score, rank): the ``k`` best rows of every window of every anchor.

    One join a round over the windows still open.  A window is done when it has ``k`` rows, all at
    or above its threshold, or its threshold was its lower end.
    """
    out, level = None, 0
    while True:
        expected = 4 * k * 8**level * sample.num_rows / max(total, 1)
        asked = staged(thresholds(anchors, sample, expected), "asked")
        best = staged(_best(joined(asked, rows, blocks, k), ["anchor_id", "wanted"], k), "found")
        window = asked.select(F.col("vec_id").alias("anchor_id"), "t", F.explode("windows").alias("w")).select("anchor_id", "t", "w.*")
        have = best.groupBy("anchor_id", "wanted").agg(F.count("*").alias("n"))
        same = F.col("w.anchor_id").eqNullSafe(F.col("h.anchor_id")) & F.col("w.wanted").eqNullSafe(F.col("h.wanted"))
        state = window.alias("w").join(have.alias("h"), same, "left").select(
            "w.anchor_id", "w.wanted", "w.low", "w.high", (F.coalesce("n", F.lit(0)) < k).alias("few"), (F.col("t") > F.coalesce("low", F.lit(float("-inf")))).alias("more"))
        again = staged(state.where("few and more").groupBy("anchor_id").agg(F.collect_list(F.struct("wanted", "low", "high")).alias("windows")), "again")
        left = again.select("anchor_id", F.explode("windows.wanted").alias("wanted"))
        gone = F.col("b.anchor_id").eqNullSafe(F.col("l.anchor_id")) & F.col("b.wanted").eqNullSafe(F.col("l.wanted"))
        done = best.alias("b").join(left.alias("l"), gone, "left_anti")
        out = done if out is None else out.unionByName(done)
        if again.isEmpty():
            return out
        anchors, level = anchors.drop("windows").join(again.withColumnRenamed("anchor_id", "vec_id"), "vec_id"), level + 1


def mine(emb: DataFrame, id_col: str = "vec_id", label_col: str = "label", vec: str = "embedding", every: int = 100, positives: int = 5,
         negatives: int = 10, low: int = 30, high: int = 90, shift_every: int = 7, labels: int = 10, block: int = 8192, sample: int = 2_000) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor, a row
    whose id ``every`` divides."""
    kept = usable(emb.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()), vec, 2.0**45)
    i, label = F.col(id_col).cast("long"), F.col(label_col).cast("long")
    moved = F.when(i % shift_every == 0, (label + 1) % labels).otherwise(label)
    x = F.transform(vec, lambda e: F.floor(e.cast("double") * 256.0).cast("double"))
    rows = staged(kept.select(i.alias("vec_id"), moved.alias("label"), x.alias("x")), "rows")
    total = rows.count()
    empty = emb.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not total:
        return empty
    blocks = -(-total // block)
    some = least_by_hash(rows, ["vec_id", "label", "x"], sample).toArrow()
    anchors = staged(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r")).select("vec_id", "r.*"), "anchors")
    own = F.array(F.struct(*[F.lit(None).cast("long").alias(c) for c in ("wanted", "low", "high")]))
    best = staged(filled(anchors.withColumn("windows", own), rows, some, total, blocks, positives), "positives")
    score = F.col("score").cast("decimal(38,0)")
    span = F.struct(F.col("vec_id").alias("wanted"), F.ceil(score * low / 100).cast("long").alias("low"), F.floor(score * high / 100).cast("long").alias("high"))
    windows = best.where("score >= 0").groupBy("anchor_id").agg(F.sort_array(F.collect_list(span)).alias("windows"))
    asked = staged(anchors.join(windows.withColumnRenamed("anchor_id", "vec_id"), "vec_id"), "windows")
    if asked.isEmpty():
        return empty
    found = filled(asked, rows, some, total, blocks, negatives)
    named = best.select("anchor_id", F.col("vec_id").alias("wanted"), F.col("score").alias("positive_score"))
    return found.join(named, ["anchor_id", "wanted"]).select(
        "anchor_id", F.col("wanted").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
