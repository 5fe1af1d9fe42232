"""Quality classifier on supervised subword embeddings.

A document is the mean of learned vectors of its hashed words, word pairs and character n-grams; a
softmax layer on that mean gives the class.  Vectors and layer are trained together by stochastic
gradient descent in numpy on all labelled documents, whole texts, in blocks.  Scoring
uses that mean and layer are linear: the layer is applied to every vector once, and a document's
logit is the mean of numbers.  So are the blocks' models averaged: the mean of their numbers.

Features are of the text alone.  An empty or null text has no features; its score is that of the
layer's bias.  Rows with equal texts score alike.  Without labels of both classes every document
scores 0.5.  An empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piste.llm.common import PIECE, least_by_hash, mix, words

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
NGRAMS = (3,)
LONGEST = 1 << 22  # features of a block, so that a task's memory does not follow the length of texts


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # logit of class 1 over class 0 by bucket
    bias: float
    buckets: int


def _pieces(text: str):
    """The text's code points, about PIECE at a time, overlapping by what the longest n-gram needs."""
    for at in range(0, len(text), PIECE):
        yield np.frombuffer(text[at : at + PIECE + max(NGRAMS) - 1].encode("utf-32-le"), np.uint32), min(PIECE, len(text) - at)


def feature_parts(text: str | None, buckets: int):
    """Buckets of the words (between white space, case and punctuation kept), of word pairs and of
    the words' character n-grams, of a whole text, a piece at a time.  A pair is hashed by exclusive
    or, so all immediate repeats, of whatever word, share a bucket.  An n-gram is of characters, not
    bytes; a blank may begin or end it and marks a word's border."""
    text = text or ""
    buf = np.frombuffer(text.encode(), np.uint8)
    if len(buf):
        h = words(buf, ~_BLANK[buf])[0]
        yield (h % np.uint64(buckets)).astype(np.int64)
        yield (mix((h[1:] ^ h[:-1]) + np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
    for part, own in _pieces(text):
        blank = (part == 32) | ((part >= 9) & (part <= 13))
        wide = np.where(blank, np.uint32(32), part)
        for n in NGRAMS:
            count = min(own, len(part) - n + 1)
            if count > 0:
                h = np.full(count, n, np.uint32)
                for j in range(n):
                    h = (h ^ wide[j : j + count]) * np.uint32(0x01000193)
                    h ^= h >> np.uint32(15)
                inside = ~np.logical_or.reduce([blank[j : j + count] for j in range(1, n - 1)]) if n > 2 else np.ones(count, bool)
                yield ((h[inside] * np.uint32(0x85EBCA6B)) >> np.uint32(7)).astype(np.int64) % buckets


def bag(text: str | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text with their shares."""
    ids, counts = np.zeros(0, np.int64), np.zeros(0)
    for part in feature_parts(text, buckets):
        i, n = np.unique(part, return_counts=True)
        ids, where = np.unique(np.concatenate([ids, i]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([counts, n]))
    return ids, counts / max(counts.sum(), 1)


def score_text(text: str | None, model: Model) -> float:
    total = n = 0.0
    for part in feature_parts(text, model.buckets):
        total += float(model.weights[part].sum())
        n += len(part)
    return float(1 / (1 + np.exp(-(total / max(n, 1) + model.bias))))


def _known(labels: DataFrame, label: str) -> DataFrame:
    return labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("label"))


def _texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, text, label): a doc_id on several rows gives one text, that of least hash."""
    least = F.min(F.struct(F.xxhash64("text").alias("h"), "text", F.col("label").cast("int").alias("label")))
    return (docs.select(F.col("doc_id").cast("long"), "text").join(chosen, "doc_id")
            .groupBy("doc_id").agg(least.alias("l")).select("doc_id", "l.text", "l.label"))


def sample(docs: DataFrame, labels: DataFrame, label: str, buckets: int, training_docs: int):
    """Bags and labels of at most ``training_docs`` labelled documents, as many of either class
    where there are enough: those of least hash of doc_id.

    The labelled ids are cut before their texts are joined, so the join's small side is bounded
    and may be broadcast.  A doc_id on several rows gives one text, that of least hash, so a
    repeated id does not outgrow the sample.
    """
    known = _known(labels, label)
    half = [least_by_hash(known.where(F.col("label") == k), ["doc_id"], training_docs // 2) for k in (0, 1)]
    chosen = F.broadcast(half[0].union(half[1]))

    def bags(batches):
        for batch in batches:
            made = [bag(t.as_py(), buckets) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1].astype(np.float32) for m in made], pa.list_(pa.float32()))],
                names=["doc_id", "label", "ids", "shares"])

    table = _texts(docs, chosen).mapInArrow(bags, "doc_id long, label int, ids array<int>, shares array<float>").toArrow()
    return table.sort_by([("doc_id", "ascending")])


def _fitted(ids: list, shares: list, y: np.ndarray, weight: tuple, buckets: int, dim: int, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, float]:
    """Stochastic gradient descent, one document a step, rate falling to zero, times its class's weight.

    Vectors start small and random.  The output starts at zero, so both train together.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.5, (buckets, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    step, steps = 0, epochs * len(y)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            eta = np.float32(rate * weight[y[i]] * (1 - step / steps))
            step += 1
            if not len(ids[i]):
                continue
            mean = shares[i] @ vectors[ids[i]]
            logits = mean @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= eta * np.outer(mean, p)
            bias -= eta * p
            # divided by the sum of squared shares, a step moves the mean by eta * back at any length
            vectors[ids[i]] -= np.outer(shares[i] * (eta / np.square(shares[i]).sum()), back)
    side = out[:, 1] - out[:, 0]
    return (vectors @ side).astype(np.float32), float(bias[1] - bias[0])


UNIT = float(1 << 24)  # block models are summed as whole multiples of 1 / UNIT, so in any order


def _fitted_in_tasks(docs: DataFrame, known: DataFrame, counts: dict[int, int], buckets: int, training_docs: int, **how) -> tuple[np.ndarray, float] | None:
    """Mean, by number of documents, of the linear forms of models fitted to blocks of about
    ``training_docs`` labelled documents; every labelled document is in one block.

    A task holds one block's bags at a time, fewer documents if they are long, and passes on the sum
    over its blocks; those sums are added by bucket.  The classes weigh alike over all blocks.
    """
    total = sum(counts.values())
    weight = tuple(total / (2 * counts[k]) for k in (0, 1))
    blocks = max(1, round(total / training_docs))

    def fit_blocks(batches):
        form, seen, block = np.zeros(buckets + 1, np.int64), np.zeros(2, np.int64), []

        def close():
            ids, shares, y = (list(c) for c in zip(*block))
            weights, bias = _fitted(ids, shares, np.array(y), weight, buckets, **how)
            form[:] += np.rint(np.append(weights, bias).astype(float) * UNIT).astype(np.int64) * len(y)
            seen[:] += np.bincount(y, minlength=2)
            block.clear()

        held = 0
        for batch in batches:
            for t, k in zip(batch.column(1), batch.column(2).to_pylist()):
                ids, shares = bag(t.as_py(), buckets)
                block.append((ids.astype(np.int32), shares.astype(np.float32), k))
                held += len(ids)
                if len(block) >= 2 * training_docs or held >= LONGEST:
                    close()
                    held = 0
        if block:
            close()
        if seen.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets + 3)), pa.array(np.concatenate([form, seen]))], names=["place", "total"])

    rows = _texts(docs, known).repartition(min(blocks, 512), "doc_id").sortWithinPartitions("doc_id")
    found = rows.mapInArrow(fit_blocks, "place long, total long").groupBy("place").agg(F.sum("total").alias("total")).toArrow().sort_by("place")
    if not found.num_rows:
        return None
    form = found["total"].to_numpy()
    seen = form[-2:]
    if not seen.all():
        return None
    form = form[:-2] / (UNIT * seen.sum())
    return form[:-1].astype(np.float32), float(form[-1])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", buckets: int = 1 << 16, dim: int = 8,
          training_docs: int = 3000, epochs: int = 12, rate: float = 0.3, seed: int = 7) -> Model:
    """The model of all labelled documents: fitted on the driver if there are at most half of
    ``training_docs`` of either class, else in blocks in tasks."""
    known = _known(labels, label)
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    how = {"dim": dim, "epochs": epochs, "rate": rate, "seed": seed}
    fitted = None
    if len(counts) == 2 and max(counts.values()) > training_docs // 2:
        fitted = _fitted_in_tasks(docs, known, counts, buckets, training_docs, **how)
    elif len(counts) == 2:
        table = sample(docs, labels, label, buckets, training_docs)
        y = table["label"].to_numpy()
        if len(set(y.tolist())) == 2:
            fitted = _fitted([a.values.to_numpy() for a in table["ids"]], [a.values.to_numpy() for a in table["shares"]], y, (1, 1), buckets, **how)
    return Model(*(fitted or (np.zeros(buckets, np.float32), 0.0)), buckets)


def scorer(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """Score column, 0 to 1: higher, label 1 likelier."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([score_text(t, shared.value) for t in texts], dtype="float64")

    return score(text)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept out of training: crc32 of doc_id as text, mod 3, is 1 (false for null)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))
