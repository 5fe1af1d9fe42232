"""Embedding whitening by Chebyshev-filtered subspace iteration.

Entries c become integers floor(256 c).  The covariance V is that of the distinct vectors, each taken
once, about their mean; it is never formed.  A block Q of ``block`` directions is held on the driver
(dimensions x ``block`` numbers), and one distributed pass gives V Q = X'(X Q) / n with X centred
first.  A few such passes with a single direction (Lanczos) estimate the lower end of the spectrum.
Each round then applies a Chebyshev polynomial of V by its three-term recurrence, one pass a degree:
it stays small between that lower end and the least wanted-side estimate and grows fast above, so
the unwanted spectrum is damped.  QR and Rayleigh-Ritz give the estimates; one pass measures their
residuals |V u - e u|.  Rounds go on until the residuals of all wanted components are at the level
of rounding.  From the third round on the block doubles until it spans all dimensions, where
Rayleigh-Ritz is exact, so that even a flat spectrum ends.

Partial products are summed by partition number in two steps, so results repeat exactly, and the driver
receives at most ``sums`` of them.

Rows whose vector is null, empty, holds null or non-finite entries, entries of 2^45 or more in
magnitude, or has not the table's length (see ``vectors``) are dropped; a null id stays a null id;
repeated rows each get their rows.  Components whose eigenvalue is zero but for rounding are left
out (one distinct vector has none), and there are no more than dimensions.  ``deviation`` is null
where it does not fit 64 bits.  Equal eigenvalues may share their components in any rotation.  Other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piste.llm.common import staged
from piste.llm.vectors import column, in_blocks, matrix, usable

OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Spectrum:
    """Fit list size, exact sums, and the wanted eigenpairs with their residuals."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    passes: int


def _totals(fit: DataFrame) -> tuple[int, list[int], int]:
    """Number of vectors, sums per dimension, and the sum of all squares, as exact integers."""
    wide = "decimal(38,0)"
    sums = (fit.select(F.posexplode("x").alias("j", "e")).groupBy("j")
            .agg(F.sum(F.col("e").cast(wide)).alias("s"), F.sum((F.col("e").cast("decimal(19,0)") * F.col("e").cast("decimal(19,0)")).cast(wide)).alias("q"), F.count("*").alias("n"))
            .orderBy("j").collect())  # a row a dimension
    return (sums[0]["n"] if sums else 0), [int(r["s"]) for r in sums], sum(int(r["q"]) for r in sums)


def _summed(fit: DataFrame, part, shape: tuple[int, int], sums: int) -> np.ndarray:
    """Sum over partitions of the matrices ``part(rows)``, in order of partition number."""

    def partial(batches):
        from pyspark import TaskContext

        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += part(matrix(column(batch, "x")))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "total"])

    def added(batches):
        total, group = None, None
        for batch in batches:
            for g, t in zip(column(batch, "g").to_pylist(), column(batch, "total").to_pylist()):
                if g != group:
                    if total is not None:
                        yield row(group, total)
                    total, group = np.zeros(shape), g
                total = total + np.frombuffer(t).reshape(shape)
        if total is not None:
            yield row(group, total)

    def row(group, total):
        return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "total"])

    parts = fit.mapInArrow(partial, "part int, total binary").withColumn("g", F.expr(f"pmod(part, {sums})"))
    rows = in_blocks(parts, ["g"], ["part"]).mapInArrow(added, "part int, total binary").collect()
    return sum((np.frombuffer(r["total"]).reshape(shape) for r in sorted(rows, key=lambda r: r["part"])), np.zeros(shape))


class Passes:
    """V times a block of directions, one pass over the fit list each."""

    def __init__(self, fit: DataFrame, n: int, mean: np.ndarray, sums: int):
        self.fit, self.n, self.mean, self.sums, self.done = fit, n, mean, sums, 0

    def __call__(self, q: np.ndarray) -> np.ndarray:
        mean = self.mean

        def part(x: np.ndarray) -> np.ndarray:
            x = x - mean
            return x.T @ (x @ q)

        self.done += 1
        return _summed(self.fit, part, q.shape, self.sums) / self.n


def lower_end(times_v, d: int, steps: int, rng) -> float:
    """Estimate, on the low side, of the least eigenvalue by Lanczos steps with full orthogonalisation."""
    basis = [rng.standard_normal(d)]
    basis[0] /= np.linalg.norm(basis[0])
    alpha, beta = [], []
    for _ in range(min(steps, d)):
        w = times_v(basis[-1][:, None])[:, 0]
        alpha.append(float(basis[-1] @ w))
        for _ in range(2):
            for b in basis:
                w = w - (b @ w) * b
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= 1e-12 * max(abs(a) for a in alpha) or len(alpha) == d:
            break
        basis.append(w / beta[-1])
    t = np.diag(alpha) + np.diag(beta[: len(alpha) - 1], 1) + np.diag(beta[: len(alpha) - 1], -1)
    values, vectors = np.linalg.eigh(t)
    return max(0.0, float(values[0] - beta[-1] * abs(vectors[-1, 0])))


def filtered(times_v, q: np.ndarray, degree: int, low: float, high: float, top: float) -> np.ndarray:
    """The scaled Chebyshev polynomial of V, small on [low, high], applied to ``q``; one pass a degree."""
    e, c = (high - low) / 2, (high + low) / 2
    sigma = first = e / (top - c)
    y = (times_v(q) - c * q) * (sigma / e)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        q, y, sigma = y, 2 * after / e * (times_v(y) - c * y) - sigma * after * q, after
    return y


def spectrum(fit: DataFrame, components: int = 4, block: int = 24, degree: int = 10, lanczos: int = 10, sums: int = 32,
             seed: int = 7) -> Spectrum:
    """The leading ``components`` of the covariance of ``fit`` (x: array of integers, distinct rows)."""
    n, total, squares = _totals(fit)
    d, rng = len(total), np.random.default_rng(seed)
    trace = n * squares - sum(s * s for s in total)  # n^2 times the trace, exact
    if trace <= 0:
        return Spectrum(n, total, 0.0, np.zeros(0), np.zeros((d, 0)), np.zeros(0), 0)
    trace = trace / (n * n)
    times_v = Passes(fit, n, np.array([s / n for s in total]), sums)
    wide, want = min(d, max(block, components)), min(components, d)
    low = lower_end(times_v, d, lanczos, rng) if wide < d else 0.0
    q, rounds, best = np.linalg.qr(rng.standard_normal((d, wide)))[0], 0, np.inf
    while True:
        vq = times_v(q)
        h = q.T @ vq
        values, w = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-values)
        values, w = values[order], w[:, order]
        u, vu = q @ w, vq @ w
        residuals = np.linalg.norm(vu - u * values, axis=0)[:want]
        worst = residuals.max() / values[0]
        if wide == d or worst <= 1e-14 or (worst <= 1e-12 and worst > best / 2):
            break
        best, rounds = min(best, worst), rounds + 1
        if rounds >= 3:
            wide = min(d, 2 * wide)
            u = np.hstack([u, rng.standard_normal((d, wide - u.shape[1]))])
        high = values[-1]
        if wide < d and high > low and values[0] > high:
            u = filtered(times_v, u, degree, low, high, values[0])
        q = np.linalg.qr(u)[0]
    some = values[:want] > 1e-12 * values[0]
    return Spectrum(n, total, trace, values[:want][some], u[:, :want][:, some], residuals[some], times_v.done)


def identity_error(fit: DataFrame, s: Spectrum, sums: int = 32) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    mean, project, k = np.array([t / s.n for t in s.sums]), s.vectors / np.sqrt(s.values), len(s.values)
    middle = _summed(fit, lambda x: ((x - mean) @ project).sum(0)[None], (1, k), sums)[0] / s.n

    def part(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ project - middle
        return w.T @ w

    return float(np.abs(_summed(fit, part, (k, k), sums) / s.n - np.eye(k)).max())


def integers(emb: DataFrame, vec: str = "embedding") -> DataFrame:
    """The usable rows with ``x``, the vector's entries as integers floor(256 c)."""
    return usable(emb, vec, 2.0**45).withColumn("x", F.transform(vec, lambda e: F.floor(e.cast("double") * 256.0).cast("long")))


def whiten(emb: DataFrame, id_col: str = "vec_id", vec: str = "embedding", components: int = 4, **options) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per row and component."""
    rows = staged(integers(emb, vec).select(F.col(id_col).cast("long").alias("vec_id"), "x"), "integers")
    fit = staged(rows.select("x").distinct(), "distinct")
    s = spectrum(fit, components, **options)
    k = len(s.values)
    if not k:
        return emb.sparkSession.createDataFrame([], OUT)
    off = identity_error(fit, s)
    mean, project = np.array([t / s.n for t in s.sums]), s.vectors / np.sqrt(s.values)
    share = s.values / s.trace
    sums = np.array(s.sums, object)
    reach = max(abs(t) for t in s.sums)

    def deviations(x: np.ndarray) -> list[int | None]:
        most = s.n * int(np.abs(x).max(initial=0)) + reach
        if len(sums) * most * most < 2**63:
            return ((s.n * x - sums.astype(np.int64)) ** 2).sum(1).tolist()
        exact = ((s.n * x.astype(object) - sums) ** 2).sum(1)
        return [int(e) if e < 2**63 else None for e in exact]

    def project_rows(batches):
        for batch in batches:
            x = matrix(column(batch, "x"), np.int64)
            if not len(x):
                continue
            white = (x - mean) @ project
            at = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "vec_id").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(at), s.n)),
                 pa.array(deviations(x), pa.int64()).take(pa.array(at)), pa.array(white.ravel()), pa.array(np.tile(share, len(x))), pa.array(np.full(len(at), off))],
                names=[c.split()[0] for c in OUT.split(", ")])

    return rows.mapInArrow(project_rows, OUT)
