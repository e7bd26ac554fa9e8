"""Embedding whitening: Chebyshev-filtered subspace iteration over distributed passes.

The covariance is never formed. Every pass multiplies a narrow block Q by it, as sums of centred
XᵀXQ over the tasks; a polynomial recurrence over such passes damps the unwanted spectrum, then QR
and Rayleigh-Ritz turn the block, until the residual of every wanted pair certifies it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

SCALE, OFFSET = 64, 1_000_000
#: Entries of a vector block that a task multiplies at once.
HELD = 1 << 20
#: The filter may not spread the wanted values by more than this, or QR would lose the smaller ones.
SPREAD = 1e9
MAX_DEGREE, LANCZOS_STEPS, MAX_ROUNDS = 12, 10, 60
RESIDUAL = 1e-13
#: A direction with less than this share of the largest variance counts as having none.
NO_VARIANCE = 1e-11


def whiten(embeddings: DataFrame, components: int = 32, guard: int = 24) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, or holds null or non-finite entries are dropped, and so are
    rows of another length than most (of equally frequent lengths the longer counts). Repeated rows
    and ids count each for itself, null ids stay null, other columns are ignored. Directions without
    variance cannot be whitened and are left out, so equal vectors, one vector or an empty table
    give no row. Components of equal eigenvalues are any basis, the same for all rows. A sum beyond
    64 bits fails instead of wrapping.

    ``guard`` more vectors than components are iterated: a wider block needs fewer passes. Two are
    the least, as the filter damps everything up to the last value of the block.
    """
    rows = usable(embeddings)
    # One small row per length that occurs at all.
    length = rows.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not length:
        return rows.sparkSession.createDataFrame([], schema)
    d, n = length[0]["d"], length[0]["count"]
    rows = rows.where(F.col("d") == d).select("vec_id", "x")
    centre = Centre(n, summed(rows, d, lambda x: x.sum(axis=0), "long"))

    def product(q: np.ndarray) -> tuple[np.ndarray, float]:
        """V Q and the trace of V, from one pass over all vectors."""

        def part(x: np.ndarray) -> np.ndarray:
            c = centre(x)
            return np.hstack([c.T @ (c @ q), (c * c).sum(axis=0)[:, None]])

        total = summed(rows, d, part, "double").reshape(d, -1) / n
        return total[:, :-1], float(total[:, -1].sum())

    values, vectors, trace = leading(product, d, components, guard)
    keep = values > NO_VARIANCE * max(values[0], np.finfo(float).tiny)
    values, vectors = values[keep], vectors[:, keep]
    k = len(values)
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    project = vectors / np.sqrt(values)

    def gram(x: np.ndarray) -> np.ndarray:
        z = centre(x) @ project
        return np.hstack([z.T @ z, z.sum(axis=0)[:, None]])

    total = summed(rows, d, gram, "double").reshape(k, -1) / n
    error = float(np.abs(total[:, :-1] - np.outer(total[:, -1], total[:, -1]) - np.eye(k)).max())
    explained = values / trace

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in vectors_of(batches, d):
            m = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)),
                    pa.array(np.repeat(centre.deviation(x), k)),
                    pa.array((centre(x) @ project).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(results, schema)


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, the entries as doubles, and their number, of all rows that can be whitened; written once."""
    x = F.col("embedding")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long"), "embedding").where(x.isNotNull() & (F.size(x) > 0) & sound)
    return stored(rows.select("vec_id", F.size(x).alias("d"), x.alias("x")), "whitening")


def vectors_of(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and the integer vectors, in blocks of bounded size."""
    step = max(1, HELD // d)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            c = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
            whole = np.floor(SCALE * c)
            if np.abs(whole).max(initial=0) >= 2.0**62:
                raise OverflowError("An entry is too large for a 64-bit integer.")
            yield part.column(0), whole.astype(np.int64) + OFFSET


def summed(rows: DataFrame, d: int, part, kind: str) -> np.ndarray:
    """The sum over all vectors of the equal-sized matrices that ``part`` makes of blocks of them.

    Each task adds up its own blocks; Spark adds the tasks' entries, so that one matrix reaches the driver.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in vectors_of(batches, d):
            block = part(x)
            total = block if total is None else total + block
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "c"])

    total = rows.mapInArrow(partial, f"i long, c {kind}").groupBy("i").agg(F.sum("c").alias("c")).toArrow().sort_by("i")
    return total.column("c").to_numpy()


class Centre:
    """x - S / n without cancellation: the whole part of the mean is taken off in integers."""

    def __init__(self, n: int, sums: np.ndarray):
        self.n, self.whole = n, sums // n
        self.rest = sums - self.whole * n

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """The sum over dimensions of (n x - S)^2."""
        off = x - self.whole
        if ((np.abs(off).astype(float) * self.n + self.n) ** 2).sum(axis=1).max(initial=0) >= 2.0**62:
            raise OverflowError("A deviation is too large for a 64-bit integer.")
        return ((off * self.n - self.rest) ** 2).sum(axis=1)


def leading(product, d: int, components: int, guard: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The largest eigenpairs of the positive semidefinite matrix behind ``product``, and its trace."""
    wanted, k = min(components, d), min(components + max(guard, 2), d)
    random = np.random.default_rng(d)
    q = np.linalg.qr(random.standard_normal((d, k)))[0]
    low = lowest(product, random.standard_normal(d)) if k < d else 0.0
    for _ in range(MAX_ROUNDS):
        vq, trace = product(q)
        h = q.T @ vq
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        residual = np.linalg.norm(vq - q * values, axis=0)[:wanted].max()
        if residual <= RESIDUAL * max(values[0], 0) or trace == 0:
            return np.maximum(values[:wanted], 0), q[:, :wanted], trace
        q = filtered(product, q, vq, low, values)
    raise ArithmeticError("The components did not converge.")


def filtered(product, q, vq, low, values) -> np.ndarray:
    """An orthonormal basis of p(V) Q, p the Chebyshev polynomial that stays small between ``low`` and the least value of the block."""
    high, top = values[-1], values[0]
    if not low < high < top:
        # All of the block is one value: nothing can be damped beside it.
        return np.linalg.qr(vq)[0]
    half, middle = (high - low) / 2, (high + low) / 2
    degree = int(np.clip(np.log(2 * SPREAD) / np.arccosh((top - middle) / half), 2, MAX_DEGREE))
    scale = half / (top - middle)
    step = 2 / scale
    before, now = q, (vq - middle * q) * (scale / half)
    for _ in range(degree - 1):
        fresh = 1 / (step - scale)
        before, now = now, 2 * (product(now)[0] - middle * now) * (fresh / half) - scale * fresh * before
        scale = fresh
    return np.linalg.qr(now / np.maximum(np.linalg.norm(now, axis=0), np.finfo(float).tiny))[0]


def lowest(product, start: np.ndarray) -> float:
    """A bound from below for the spectrum: the least Lanczos value less the last residual."""
    v, before, off = start / np.linalg.norm(start), np.zeros_like(start), 0.0
    diagonal, beside = [], []
    for _ in range(min(LANCZOS_STEPS, len(start))):
        w = product(v[:, None])[0][:, 0] - off * before
        diagonal.append(v @ w)
        w = w - diagonal[-1] * v
        off = float(np.linalg.norm(w))
        beside.append(off)
        if off <= 1e-9 * max(diagonal):
            break
        before, v = v, w / off
    values = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(beside[:-1], 1) + np.diag(beside[:-1], -1))
    return max(0.0, values[0] - off)
