"""Benchmark decontamination by greedy string tiling.

Seeds are the hashed runs of ``least`` words.  The benchmark's seeds are a table; documents keep the
seeds that a bitmap of it holds, and both are joined by seed.  A pair of document and item goes on
if its shared seeds can cover the asked share of the item: a tile of n words has n - least + 1 seeds,
so ``least`` words a seed is the most that they cover.

For each such pair the longest run of words that matches and is not yet marked on either side
becomes a tile, again and again until no match of ``least`` words is left; runs are compared by
rolling (Karp-Rabin) hashes of words.  The share of an item's words under tiles is its coverage.
Tiles may lie in any order, so reordered passages are caught.

The matches of a pair are listed from its seed pairs, or, where words repeat so often that there are
more than ``listed_pairs`` of these, found row by row in memory for one row of the document's words.

Items shorter than ``least`` words match as a whole run.  Null or empty items and documents match
nothing; null ids, of documents and of items, are reported as null and clean up like others.  Rows
equal in id and text are one document or item; equal items under two ids are both reported; other
columns, of any name, are ignored; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piste.llm.common import grams, staged, unused, word_hashes
from piste.llm.vectors import in_blocks

SCHEMA = "doc_id long, item_id long, coverage double, tiles int"
LISTED_PAIRS = 2_000_000


def tiles(pairs: np.ndarray, least: int, size: int | None = None) -> list[tuple[int, int, int]]:
    """Greedy tiling from seed pairs (place in item, place in document): (item, document, length).

    Seeds on a diagonal that follow one another are one maximal match.  The longest match is
    taken first, ties by place; what marking leaves of a match goes back in line.  Once all
    ``size`` words of the item are marked nothing can follow.
    """
    order = np.lexsort((pairs[:, 0], pairs[:, 1] - pairs[:, 0]))
    a, b = pairs[order, 0], pairs[order, 1]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(b - a) != 0) | (np.diff(a) != 1)]))
    length = np.diff(np.append(first, len(a))) + least - 1
    line = [(-int(n), int(i), int(j)) for n, i, j in zip(length, a[first], b[first])]
    heapq.heapify(line)
    in_item, in_doc, out = set(), set(), []
    while line and len(in_item) != size:
        n, i, j = heapq.heappop(line)
        free = [i + k not in in_item and j + k not in in_doc for k in range(-n)]
        if all(free):
            out.append((i, j, -n))
            in_item.update(range(i, i - n))
            in_doc.update(range(j, j - n))
            continue
        k = 0
        while k < -n:
            end = k
            while end < -n and free[end]:
                end += 1
            if end - k >= least:
                heapq.heappush(line, (k - end, i + k, j + k))
            k = end + 1
    return out


def tiles_by_rows(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The same tiles as :func:`tiles`, without the list of seed pairs: the length of the match that
    starts at each pair of places, one item place after the other, again for every tile."""
    free_item, free_doc, out = np.ones(len(item), bool), np.ones(len(doc), bool), []
    while free_item.any():
        best, run = (0, 0, 0), np.zeros(len(doc) + 1, np.int32)
        for i in range(len(item) - 1, -1, -1):
            run[:-1] = np.where((doc == item[i]) & free_doc & free_item[i], run[1:] + 1, 0)
            longest = int(run.max())
            if longest and longest >= best[0]:
                best = (longest, i, int(run.argmax()))
        n, i, j = best
        if n < least:
            break
        out.append((i, j, n))
        free_item[i : i + n] = False
        free_doc[j : j + n] = False
    return out


def covered(item: np.ndarray, doc: np.ndarray, least: int, listed_pairs: int = LISTED_PAIRS) -> tuple[float, int]:
    """Share of the item's words under tiles, and the number of tiles."""
    least = min(least, len(item))
    if not least or len(doc) < least:
        return 0.0, 0
    own, other = grams(item, least), grams(doc, least)
    order = np.argsort(own, kind="stable")
    left, right = np.searchsorted(own[order], other, "left"), np.searchsorted(own[order], other, "right")
    each = right - left
    if each.sum() > listed_pairs:
        made = tiles_by_rows(item, doc, least)
    elif each.sum():
        seed = np.arange(each.sum()) + np.repeat(left - (np.cumsum(each) - each), each)
        made = tiles(np.stack([order[seed], np.repeat(np.arange(len(other)), each)], 1), least, len(item))
    else:
        made = []
    return sum(n for *_, n in made) / len(item), len(made)


def item_seeds(items: DataFrame, least: int) -> DataFrame:
    """(item_id, item_hash, seed, places, words, run): the seeds of every item, how often each stands,
    the item's words and the length of its runs."""

    def make(batches):
        for batch in batches:
            rows = []
            for i, ih, t in zip(*(c.to_pylist() for c in batch.columns)):
                h = word_hashes(t)
                if len(h):
                    seeds, places = np.unique(grams(h, least), return_counts=True)
                    rows += [(i, ih, s, n, len(h), min(least, len(h))) for s, n in zip(seeds.astype(np.int64).tolist(), places.tolist())]
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["item_id", "item_hash", "seed", "places", "words", "run"])

    return items.mapInArrow(make, "item_id long, item_hash long, seed long, places long, words long, run long")


def bitmap(seeds: DataFrame, count: int, least_bits: int = 16, most_bits: int = 27) -> np.ndarray:
    """Which leading bits occur among the seeds, at about 16 bits a seed (2 ** ``most_bits`` at most):
    partial bitmaps are joined in tasks, the driver receives 16 of them."""
    bits = min(most_bits, max(least_bits, (16 * max(count, 1)).bit_length()))

    def partial(batches):
        from pyspark import TaskContext

        total = np.zeros(1 << bits, bool)
        for batch in batches:
            total[(batch.column(0).to_numpy().astype(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)] = True
        yield row(TaskContext.get().partitionId() % 16, total)

    def joined(batches):
        total, group = None, None
        for batch in batches:
            for g, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                one = np.unpackbits(np.frombuffer(b, np.uint8)).view(bool)
                if g != group and total is not None:
                    yield row(group, total)
                total = one if g != group else total | one
                group = g
        if total is not None:
            yield row(group, total)

    def row(group: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([np.packbits(total).tobytes()], pa.binary())], names=["g", "bits"])

    out = np.zeros(1 << bits, bool)
    for r in in_blocks(seeds.mapInArrow(partial, "g int, bits binary"), ["g"], []).mapInArrow(joined, "g int, bits binary").toLocalIterator():
        out |= np.unpackbits(np.frombuffer(r["bits"], np.uint8)).view(bool)
    return out


def document_seeds(docs: DataFrame, known: np.ndarray, runs: list[int]) -> DataFrame:
    """(doc_id, doc_hash, seed): the distinct seeds of each document that the bitmap holds."""
    shared, shift = docs.sparkSession.sparkContext.broadcast(np.packbits(known)), np.uint64(64 - (len(known).bit_length() - 1))

    def make(batches):
        bits = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            ids, hashes, seeds = [], [], []
            for i, dh, t in zip(*(batch.column(k) for k in range(3))):
                h = word_hashes(t.as_py())
                for n in runs:
                    if len(h) >= n:
                        g = grams(h, n)
                        g = np.unique(g[bits[(g >> shift).astype(np.int64)]]).astype(np.int64)
                        ids += [i.as_py()] * len(g)
                        hashes += [dh.as_py()] * len(g)
                        seeds.append(g)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(np.concatenate(seeds) if seeds else np.zeros(0, np.int64))],
                names=["doc_id", "doc_hash", "seed"])

    return docs.mapInArrow(make, "doc_id long, doc_hash long, seed long")


def _same(a: str, b: str, *columns: str):
    """Null-safe equality of columns of two aliased tables."""
    return [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns]


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.6, listed_pairs: int = LISTED_PAIRS) -> DataFrame:
    """(doc_id, item_id, coverage, tiles): pairs whose coverage reaches the threshold."""
    return _pairs(docs, benchmark, least, coverage, listed_pairs).select("doc_id", "item_id", "coverage", "tiles")


def _pairs(docs: DataFrame, benchmark: DataFrame, least: int, coverage: float, listed_pairs: int = LISTED_PAIRS) -> DataFrame:
    """The pairs with ``doc_hash``, the hash of the document's text."""
    schema = "doc_id long, doc_hash long, item_id long, coverage double, tiles int"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("doc_hash"), "text")
    items = staged(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("item_hash"), "text").distinct(), "items")
    seeds = staged(item_seeds(items, least), "seeds")
    size = seeds.agg(F.count("*").alias("n"), F.sort_array(F.collect_set("run")).alias("runs")).first()
    if not size["n"]:
        return docs.sparkSession.createDataFrame([], schema)
    met = document_seeds(texts, bitmap(seeds.select("seed"), size["n"]), size["runs"]).join(seeds, "seed")
    hits = met.groupBy("doc_id", "doc_hash", "item_id", "item_hash").agg(F.sum("places").alias("places"), F.first("words").alias("words"), F.first("run").alias("run"))
    able = staged(hits.where(F.col("places") * F.col("run") >= coverage * F.col("words") - 1e-9).drop("places", "words", "run"), "pairs")
    text_of = lambda c: F.first(f"t.{c}").alias(c)
    asked = able.select("doc_id", "doc_hash").distinct()
    theirs = texts.alias("t").join(asked.alias("a"), _same("t", "a", "doc_id", "doc_hash"), "left_semi").groupBy("doc_id", "doc_hash").agg(text_of("text"))
    both = (able.alias("p").join(theirs.alias("d"), _same("p", "d", "doc_id", "doc_hash")).join(items.alias("i"), _same("p", "i", "item_id", "item_hash"))
            .select("p.doc_id", "p.doc_hash", "p.item_id", F.col("i.text").alias("item"), F.col("d.text").alias("text")))

    def tile(batches):
        for batch in batches:
            rows = []
            for d, dh, i, item, text in zip(*(batch.column(k) for k in range(5))):
                share, n = covered(word_hashes(item.as_py()), word_hashes(text.as_py()), least, listed_pairs)
                if share >= coverage:
                    rows.append((d.as_py(), dh.as_py(), i.as_py(), share, n))
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "doc_hash", "item_id", "coverage", "tiles"])

    return both.mapInArrow(tile, schema)


def clean(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.6) -> DataFrame:
    """The documents that no benchmark item contaminates, all their columns."""
    own, its_id, its_hash = unused(docs, "own_hash", "found_id", "found_hash")
    found = staged(_pairs(docs, benchmark, least, coverage).select(F.col("doc_id").alias(its_id), F.col("doc_hash").alias(its_hash)).distinct(), "found")
    return docs.withColumn(own, F.xxhash64("text")).join(
        found, F.col("doc_id").cast("long").eqNullSafe(F.col(its_id)) & (F.col(own) == F.col(its_hash)), "left_anti").drop(own)
