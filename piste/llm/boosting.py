"""Gradient-boosted regression trees for two classes, on binned features, in numpy.

Small on purpose: it is shipped to tasks whole.  It is fitted to all rows: to few on the driver, to many
by sums that their tasks make.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piste.llm.common import discard, staged

Tree = tuple[np.ndarray, np.ndarray, np.ndarray]  # feature, threshold, leaf value of a full tree


@dataclass
class Boosted:
    start: float
    trees: list[Tree]
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for feature, threshold, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
            out += leaf[node - (2**self.depth - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def _cuts(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """Distinct lower quantiles of the sorted ``values``, each as often as it counts."""
    upto = np.cumsum(counts)
    places = np.floor(np.linspace(0, 1, bins + 1)[1:-1] * (upto[-1] - 1))
    return np.unique(values[np.searchsorted(upto, places, side="right")])


#: Gradients are summed as whole multiples of 1 / UNIT, so that a sum does not depend on its order.
UNIT = float(1 << 24)


def _node(binned: np.ndarray, feature: np.ndarray, at: np.ndarray, levels: int) -> np.ndarray:
    node, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
    for _ in range(levels):
        node = 2 * node + 1 + (binned[rows, feature[node]] > at[node])
    return node


def _raw(binned: np.ndarray, start: float, trees: list, depth: int) -> np.ndarray:
    out = np.full(len(binned), start)
    for feature, at, leaf in trees:
        out += leaf[_node(binned, feature, at, depth) - (2**depth - 1)]
    return out


def _sums(binned: np.ndarray, y: np.ndarray, n: np.ndarray, raw: np.ndarray, feature: np.ndarray, at: np.ndarray, level: int, bins: int) -> np.ndarray:
    """Gradients and curvatures by node of the level, feature and bin."""
    p = 1 / (1 + np.exp(-raw))
    grad, hess = np.rint((y - p) * UNIT) * n, np.rint(p * (1 - p) * UNIT) * n
    first, width, columns = 2**level - 1, 2**level, binned.shape[1]
    cell = (((_node(binned, feature, at, level) - first)[:, None] * columns + np.arange(columns)) * bins + binned).ravel()
    return np.stack([np.bincount(cell, np.repeat(v, columns), width * columns * bins).reshape(width, columns, bins) for v in (grad, hess)])


def _grown(start: float, cuts: list[np.ndarray], sums: Callable, rounds: int, depth: int, rate: float, ridge: float) -> Boosted:
    """Newton steps on the logistic loss; every tree is a full one of ``depth`` levels.  ``sums`` gives the
    ``_sums`` of all rows, for the trees so far and the first levels of the next one."""
    model, trees, inner = Boosted(start, [], depth), [], 2**depth - 1
    for _ in range(rounds):
        feature, at, threshold = np.zeros(inner, np.int64), np.full(inner, np.iinfo(np.uint8).max), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.zeros(width)
            g, h = (v.cumsum(2) / UNIT for v in sums(trees, feature, at, level))
            total = np.stack([g[:, 0, -1], h[:, 0, -1]])
            below = total.copy()  # of nodes that no split divides, all rows go left
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                all_g, all_h = total[0][:, None], total[1][:, None]
                gain = g[:, f] ** 2 / (h[:, f] + ridge) + (all_g - g[:, f]) ** 2 / (all_h - h[:, f] + ridge) - all_g**2 / (all_h + ridge)
                place = gain[:, : len(cut)].argmax(1)
                here = gain[np.arange(width), place]
                better = np.flatnonzero(here > best + 1e-9)
                best[better] = here[better]
                feature[first + better], at[first + better], threshold[first + better] = f, place[better], cut[place[better]]
                below[:, better] = g[better, f, place[better]], h[better, f, place[better]]
        parts = np.stack([below, total - below], 2).reshape(2, -1)
        leaf = rate * parts[0] / (parts[1] + ridge)
        trees.append((feature, at, leaf))
        model.trees.append((feature, threshold, leaf))
    return model


def _start(positives: float, total: float) -> float:
    mean = np.clip(positives / total, 1e-6, 1 - 1e-6)
    return float(np.log(mean / (1 - mean)))


def fit(x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None, rounds: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Boosted:
    """Model of rows that the driver holds, each counting ``n`` times."""
    y, n = y.astype(float), np.ones(len(y)) if n is None else n.astype(float)
    cuts = []
    for column in x.T:
        values, where = np.unique(column, return_inverse=True)
        cuts.append(_cuts(values, np.bincount(where, n), bins))
    binned = np.stack([np.searchsorted(cut, c, side="left") for cut, c in zip(cuts, x.T)], 1)
    start = _start((y * n).sum(), n.sum())
    raw, done = np.full(len(y), start), 0

    def sums(trees, feature, at, level):
        nonlocal raw, done
        raw, done = raw + _raw(binned, 0.0, trees[done:], depth), len(trees)
        return _sums(binned, y, n, raw, feature, at, level, bins)

    return _grown(start, cuts, sums, rounds, depth, rate, ridge)


def fit_rows(rows: DataFrame, rounds: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, tasks: int = 32) -> Boosted:
    """As :func:`fit`, of all ``rows`` (x array<double>, label boolean, n long), which stay in their tasks: for a
    level of a tree every task sums its rows, and the driver adds up at most ``tasks`` sums of one size."""
    found = rows.select(F.posexplode("x").alias("f", "value"), "n").groupBy("f", "value").agg(F.sum("n").alias("n")).orderBy("f", "value").toPandas()
    cuts = [_cuts(g["value"].to_numpy(), g["n"].to_numpy(), bins) for _, g in found.groupby("f")]
    total = rows.agg(F.sum(F.col("label").cast("long") * F.col("n")), F.sum("n")).first()
    start = _start(*total)

    def bin_rows(batches):
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float).reshape(batch.num_rows, -1)
            binned = np.stack([np.searchsorted(cut, c, side="left") for cut, c in zip(cuts, x.T)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in binned], pa.binary()), batch.column(1), batch.column(2)], names=["binned", "label", "n"])

    made = staged(rows.select("x", "label", "n").mapInArrow(bin_rows, "binned binary, label boolean, n long").coalesce(tasks), "binned")

    def sums(trees, feature, at, level):
        def add(batches):
            out = 0.0
            for batch in batches:
                if batch.num_rows:
                    binned = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, -1).astype(np.int64)
                    y, n = (batch.column(i).cast(pa.int64()).to_numpy().astype(float) for i in (1, 2))
                    out = out + _sums(binned, y, n, _raw(binned, start, trees, depth), feature, at, level, bins)
            if not np.isscalar(out):
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])

        parts = [np.frombuffer(r["sums"]) for r in made.mapInArrow(add, "sums binary").collect()]
        return sum(parts).reshape(2, 2**level, len(cuts), bins)

    model = _grown(start, cuts, sums, rounds, depth, rate, ridge)
    discard(made)
    return model


def calibrated(score: np.ndarray, label: np.ndarray, precision: float, n: np.ndarray | None = None) -> float:
    """Least score from which on the share of positives reaches ``precision``; infinite if none.  A row
    counts ``n`` times."""
    order = np.argsort(-score, kind="stable")
    n = np.ones(len(score)) if n is None else n
    share = np.cumsum((label * n)[order]) / np.cumsum(n[order])
    ends = np.append(np.diff(score[order]) != 0, True)[: len(order)]  # all of equal score together
    fine = np.flatnonzero((share >= precision) & ends)
    return float(score[order][fine[-1]]) if len(fine) else float("inf")
