"""Approximate nearest neighbours by an inverted multi-index.

Vectors are scaled to length 1 and cut into two halves, each quantised by a codebook of its own, so a
vector lies in the cell of a pair of centroids.  A query walks the pairs by summed squared distance
of its halves to the centroids, with a heap over the two sorted lists; the rows of the cells it meets
are ranked again by their exact cosine.

A query walks twice.  The first walk ends once its cells hold ``first`` rows; the k-th nearest of them
bounds the true k-th distance from above.  The second walk goes on, over the same cells and further
ones, as long as the pair's summed distance is within the query's reach.  The reach is what a share
``recall`` of the true neighbours of comparable queries needed: at most ``tuning`` queries are
compared with all rows, and those count whose k-th distance is near the query's own.  Where fewer than
``EVIDENCE`` neighbours count, the reach is the one that the triangle inequality proves to miss
nothing: a row within distance r lies in a cell no farther than r and the largest distance of any row
to its own centroids.  No cell, and no number of rows, is capped.

The codebooks are fitted on the ``sample`` rows of least hash; every row is indexed.  Cells are packed into
blocks of about ``block`` rows, and a cell of more is split over several, so one vector repeated in a
third of all rows is as many blocks as its rows ask for.  A query goes once to each block that it
meets, with the cells it wants there, and leaves k rows at most per block.

Rows with a null id, and vectors that are null, empty, zero, hold null or non-finite entries or have
not the table's length (see ``vectors``) take no part.  A row is found by its id: a query finds no
row of its own id, and rows equal in id and vector count once; of several vectors under a query's
id the least one asks.  Equal scores go by id.  Vector lengths may be extreme: they are scaled by
powers of two, which leaves the cosine unchanged.  Other columns are ignored; an empty table gives an
empty result; fewer candidates than k are all returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from piste.llm.common import least_by_hash, staged
from piste.llm.vectors import column, in_blocks, matrix, runs, usable

EVIDENCE = 100
ALIKE = 1.25  # k-th squared distances within this factor are comparable
SLACK = 1e-9  # rounding of the fast products; all rows this close to the k-th are ranked exactly


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest entry to about 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None]) if x.size else x


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None] if x.size else x


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of one vector with the rows of ``x``, each sum taken entry after entry."""
    total = lambda m: np.cumsum(m, axis=1)[:, -1]
    return np.clip(total(x * q) / np.sqrt(total(q[None] * q[None]) * total(x * x)), -1.0, 1.0)


def codebook(x: np.ndarray, count: int, rounds: int = 15) -> np.ndarray:
    """Centroids of the rows by Lloyd's rounds from the first ``count`` distinct rows."""
    _, first = np.unique(x, axis=0, return_index=True)
    centres = x[np.sort(first)[:count]]
    for _ in range(rounds):
        nearest = np.argmin((centres * centres).sum(1)[None] - 2 * x @ centres.T, axis=1)
        held = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        centres = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centres)
    return centres


class Codes:
    """The two codebooks; a cell is ``i * len(second) + j``."""

    def __init__(self, x: np.ndarray, count: int):
        self.half = x.shape[1] // 2
        self.first, self.second = codebook(x[:, : self.half], count), codebook(x[:, self.half :], count)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of the halves of unit rows to every centroid."""
        def to(part: np.ndarray, centres: np.ndarray) -> np.ndarray:
            return np.maximum((part * part).sum(1)[:, None] + (centres * centres).sum(1)[None] - 2 * part @ centres.T, 0)

        return to(x[:, : self.half], self.first), to(x[:, self.half :], self.second)


class Reach:
    """How far the second walk of a query goes, by its k-th squared distance so far."""

    def __init__(self, kth: np.ndarray, away: np.ndarray, recall: float, radius: float):
        order = np.argsort(kth, kind="stable")
        self.kth, self.away, self.recall, self.radius = kth[order], away[order], recall, radius

    def __call__(self, kth: float | None) -> float:
        if kth is None:
            return np.inf
        proven = (np.sqrt(max(kth, 0.0)) + self.radius) ** 2 + SLACK
        a, b = np.searchsorted(self.kth, [kth / ALIKE, kth * ALIKE])
        if b - a < EVIDENCE:
            return proven
        # what the needed distances exceed the k-th ones by, so that nearer bounds reach less far
        return min(proven, kth + float(np.quantile(self.away[a:b] - self.kth[a:b], self.recall, method="higher")) + SLACK)


def walk(one: np.ndarray, two: np.ndarray) -> Iterator[tuple[float, int]]:
    """(summed distance, cell) of all centroid pairs, nearest first."""
    a, b = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
    u, v, a, b, wide = one[a].tolist(), two[b].tolist(), a.tolist(), b.tolist(), len(two)
    line = [(u[0] + v[0], 0, 0)]
    while line:
        d, i, j = heapq.heappop(line)
        yield d, a[i] * wide + b[j]
        if j + 1 < len(v):
            heapq.heappush(line, (u[i] + v[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(u):
            heapq.heappush(line, (u[i + 1] + v[0], i + 1, 0))


def packed(counts: dict[int, int], block: int) -> dict[int, tuple[int, int]]:
    """Cell -> (first block, number of blocks): cells in order, as many to a block as fit."""
    out, at, held = {}, 0, 0
    for cell in sorted(counts):
        n = counts[cell]
        if held and held + n > block:
            at, held = at + 1, 0
        many = -(-n // block)
        out[cell] = (at, many)
        at, held = (at + many, 0) if many > 1 else (at, held + n)
    return out


def nearest(q: np.ndarray, qid: int, x: np.ndarray, ids: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``k`` nearest rows by exact cosine, ties by id, and their cosines; ``rough`` has the
    fast products, -inf for rows out of question."""
    rough = np.where(ids == qid, -np.inf, rough)
    kth = np.partition(rough, len(rough) - k)[len(rough) - k] if len(rough) > k else -np.inf
    at = np.flatnonzero((rough >= kth - SLACK) & (rough > -np.inf))
    score = cosine(q, x[at])
    order = np.lexsort((ids[at], -score))[:k]
    return at[order], score[order]


FOUND = "query_id long, vec_id long, score double"


def _found(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))],
                                      names=["query_id", "vec_id", "score"])


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked(wanted: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of every query in each block: queries (block, vec_id, vec, cells) with the rows
    (block, vec_id, vec, cell) of their cells."""
    kinds = {"kind": F.lit(0), "cells": F.lit(None).cast("array<int>")}
    both = rows.select("block", "vec_id", "vec", "cell").withColumns(kinds).unionByName(
        wanted.select("block", "vec_id", "vec", "cells").withColumns({"kind": F.lit(1), "cell": F.lit(None).cast("int")}))

    def score(batches):
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
                ids, cell = table["vec_id"].to_numpy(), table["cell"].to_numpy()
                x = scaled(matrix(table["vec"]))
                order = np.lexsort((*x.T[::-1], ids, cell))
                ids, cell, x = ids[order], cell[order], x[order]
                new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (cell[1:] != cell[:-1]) | (x[1:] != x[:-1]).any(1)])
                ids, cell, x = ids[new], cell[new], x[new]
                rows_unit = unit(x)
            for s in range(0, part.num_rows, 256):
                some = part.slice(s, 256)
                qids, cells = column(some, "vec_id").to_numpy(), column(some, "cells")
                q = scaled(matrix(column(some, "vec")))
                q_unit, rough = unit(q), np.full((len(q), len(x)), -np.inf)
                wants = cells.flatten().to_numpy()
                who = np.repeat(np.arange(len(q)), cells.value_lengths().to_numpy())
                by = np.argsort(wants, kind="stable")
                wants, who = wants[by], who[by]
                for c in np.unique(wants):
                    a, b = np.searchsorted(cell, [c, c + 1])
                    asking = who[slice(*np.searchsorted(wants, [c, c + 1]))]
                    rough[asking, a:b] = q_unit[asking] @ rows_unit[a:b].T
                out = []
                for i, qid in enumerate(qids):
                    places, scores = nearest(q[i], qid, x, ids, rough[i], k)
                    out += [(int(qid), int(ids[p]), float(v)) for p, v in zip(places, scores)]
                yield _found(out)

    return in_blocks(both, ["block"], ["kind", "vec_id"]).mapInArrow(score, FOUND)


def walked(queries: DataFrame, codes: Codes, blocks: dict, counts: dict, first: int, reach: Reach | None = None) -> DataFrame:
    """A row (block, vec_id, vec, cells) per query and block: the cells until they hold ``first`` rows, and
    with ``reach`` those within it by the query's ``kth``."""

    def go(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = codes.distances(unit(scaled(matrix(column(batch, "vec")))))
            limits = [-1.0] * len(one) if reach is None else [reach(k) for k in column(batch, "kth").to_pylist()]
            rows: dict[str, list] = {"block": [], "row": [], "cells": []}
            for i in range(len(one)):
                held, by_block = 0, {}
                for d, cell in walk(one[i], two[i]):
                    if held >= first and d > limits[i]:
                        break
                    if cell in blocks:
                        held += counts[cell]
                        start, many = blocks[cell]
                        for b in range(start, start + many):
                            by_block.setdefault(b, []).append(cell)
                rows["block"] += by_block
                rows["row"] += [i] * len(by_block)
                rows["cells"] += by_block.values()
            at = pa.array(rows["row"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["block"], pa.int32()), column(batch, "vec_id").take(at), column(batch, "vec").take(at), pa.array(rows["cells"], pa.list_(pa.int32()))],
                names=["block", "vec_id", "vec", "cells"])

    return queries.mapInArrow(go, f"block int, vec_id long, vec {queries.schema['vec'].dataType.simpleString()}, cells array<int>")


def tuned(rows: DataFrame, queries: DataFrame, codes: Codes, k: int, recall: float, tuning: int, radius: float) -> Reach:
    """The reach, from the true neighbours of ``tuning`` queries at most, each compared with all rows, and
    the distances of their cells."""
    asked = least_by_hash(queries.select("vec_id", "vec"), ["vec_id"], tuning).toArrow()
    if not asked.num_rows:
        return Reach(np.zeros(0), np.zeros(0), recall, radius)
    qids, q = asked["vec_id"].to_numpy(), scaled(matrix(asked["vec"]))
    q_unit = unit(q)
    one, two = codes.distances(q_unit)
    wide = len(codes.second)

    def compare(batches):
        best: dict[int, list] = {i: [] for i in range(len(q))}
        for batch in batches:
            x, ids, cell = scaled(matrix(column(batch, "vec"))), column(batch, "vec_id").to_numpy(), column(batch, "cell").to_numpy()
            if not len(x):
                continue
            rough = q_unit @ unit(x).T
            for i in best:
                places, scores = nearest(q[i], qids[i], x, ids, rough[i], k)
                new = [(-float(v), int(ids[p]), float(one[i, cell[p] // wide] + two[i, cell[p] % wide])) for p, v in zip(places, scores)]
                best[i] = sorted({*best[i], *new})[:k]
        flat = [(int(qids[i]), v, -s, d) for i in best for s, v, d in best[i]]
        cols = list(zip(*flat)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))],
                                         names=["query_id", "vec_id", "score", "away"])

    top = _top(rows.select("vec_id", "vec", "cell").mapInArrow(compare, FOUND + ", away double"), k)
    kth = F.min("score").over(Window.partitionBy("query_id"))
    needed = top.select("away", (2 - 2 * kth).alias("kth")).toArrow()
    return Reach(needed["kth"].to_numpy(), needed["away"].to_numpy(), recall, radius)


def search(emb: DataFrame, id_col: str = "vec_id", vec: str = "embedding", every: int = 50, k: int = 5, recall: float = 0.95,
           sample: int = 20_000, tuning: int = 256, cell_rows: int = 16, most_centres: int = 256, block: int = 4096, first: int = 256,
           first_share: float = 0.04) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row whose id ``every`` divides.

    Codebooks have sqrt(rows / ``cell_rows``) centroids a half, ``most_centres`` at most.  The first walk
    asks for ``first`` rows, or ``first_share`` of all if that is more: the better its bound, the shorter
    the second walk.
    """
    zero = ~F.exists(vec, lambda e: e != 0)
    rows = usable(emb, vec).where(~zero & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec).alias("vec"))
    fitted = least_by_hash(rows, ["vec_id", "vec"], sample).toArrow()
    if not fitted.num_rows:
        return emb.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    count = rows.count()
    codes = Codes(unit(scaled(matrix(fitted["vec"]))), max(1, min(most_centres, round((count / cell_rows) ** 0.5))))

    def assign(batches):
        for batch in batches:
            x = unit(scaled(matrix(column(batch, "vec"))))
            one, two = codes.distances(x) if len(x) else (np.zeros((0, 1)), np.zeros((0, 1)))
            cell = one.argmin(1) * len(codes.second) + two.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(np.sqrt(one.min(1) + two.min(1)))], names=["vec_id", "vec", "cell", "off"])

    indexed = staged(rows.mapInArrow(assign, f"vec_id long, vec {rows.schema['vec'].dataType.simpleString()}, cell int, off double"), "cells")
    cells = indexed.groupBy("cell").agg(F.count("*").alias("n"), F.max("off").alias("off")).collect()  # most_centres ** 2 at most
    counts = {r["cell"]: r["n"] for r in cells}
    blocks = packed(counts, block)
    places = emb.sparkSession.createDataFrame([(c, *b) for c, b in blocks.items()], "cell int, start int, many int")
    dealt = indexed.join(F.broadcast(places), "cell").withColumn("block", F.expr("cast(start + pmod(xxhash64(vec_id), many) as int)"))
    queries = staged(indexed.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vec").alias("vec")), "queries")
    reach = tuned(indexed, queries, codes, k, recall, tuning, max(r["off"] for r in cells))

    first = max(first, round(first_share * count))
    near = ranked(walked(queries, codes, blocks, counts, first), dealt, k)
    bound = _top(near, k).groupBy("query_id").agg((2 - 2 * F.min("score")).alias("kth"), F.count("*").alias("n")).where(F.col("n") == k)
    bound = staged(bound.select(F.col("query_id").alias("vec_id"), "kth"), "bounds")
    asked = queries.join(bound, "vec_id", "left").select("vec_id", "vec", "kth")
    found = ranked(walked(asked, codes, blocks, counts, first, reach), dealt, k)
    return _top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
