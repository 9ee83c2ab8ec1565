"""Embedding whitening: the leading eigenvectors of a covariance by Jacobi-Davidson, matrix-free."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .vectors import finite, floors, matrix

#: Rows that a task turns into floating point at a time.
ROWS = 2048
#: Integer components are packed in 32 bits; ``SHIFT`` is added to each.
MOST, SHIFT = 2.0**31 - 2_000_000, 1_000_000
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _integers(batch: pa.RecordBatch, scale: float) -> np.ndarray:
    return floors(matrix(batch.column("embedding")), scale, MOST) + SHIFT


def fit_list(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """Each distinct integer vector once, packed (``x``), as a table in the shared folder. Equal vectors meet
    in the task before they are shuffled, so one that a third of all rows hold adds a row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in _integers(batch, scale).astype(np.int32)], pa.binary())], ["x"])

    return written(vectors.select("embedding").mapInArrow(run, "x binary").distinct(), "fit-list")


def _unpacked(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for a in range(0, batch.num_rows, ROWS):
        blobs = batch.column(0).slice(a, ROWS).to_pylist()
        if any(len(b) != len(blobs[0]) for b in blobs):
            raise ValueError("the vectors have several lengths")
        yield np.frombuffer(b"".join(blobs), np.int32).reshape(len(blobs), -1).astype(np.int64)


class Centre:
    """The mean of the fit list, S / n, as integers and the rest under one, so that rows are centred in
    integers first and lose nothing to the size of their components."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.floor = np.array([s // n for s in sums], np.int64)
        self.left = np.array([s % n for s in sums], np.int64)

    def off(self, x: np.ndarray) -> np.ndarray:
        return (x - self.floor).astype(float) - self.left / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Of each row the sum of (n * x - S)^2, exact; null where it doesn't fit 64 bits."""
        d = x - self.floor
        bound = self.n * (int(np.abs(d).max(initial=0)) + 1)
        if x.shape[1] * bound * bound < 1 << 63:
            e = d * self.n - self.left
            return (e * e).sum(1).tolist()
        e = d.astype(object) * self.n - self.left.astype(object)
        return [v if v < 1 << 63 else None for v in (e * e).sum(1).tolist()]


def centre_of(fit: DataFrame) -> Centre:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, None
        for batch in batches:
            for x in _unpacked(batch):
                n, s = n + len(x), x.sum(0) if s is None else s + x.sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(s)), pa.int32()), pa.array(s), pa.array([n] * len(s), pa.int64())], ["at", "s", "n"])

    rows = fit.mapInArrow(run, "at int, s long, n long").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).orderBy("at").collect()
    if len({r["n"] for r in rows}) > 1:
        raise ValueError("the vectors have several lengths")
    return Centre(rows[0]["n"], [int(r["s"]) for r in rows]) if rows else Centre(1, [])


def covariance_times(fit: DataFrame, centre: Centre) -> Callable[[np.ndarray], np.ndarray]:
    """A function of a block of vectors: the covariance times each, as one pass over the fit list. Each row
    is centred, then multiplied; a task's sums are a row a dimension, added by Spark. The covariance
    itself is never made."""

    def times(block: np.ndarray) -> np.ndarray:
        k = block.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(block)
            for batch in batches:
                for x in _unpacked(batch):
                    c = centre.off(x)
                    total += c.T @ (c @ block)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), *[pa.array(total[:, i].copy()) for i in range(k)]], ["at", *[f"c{i}" for i in range(k)]])

        sums = fit.mapInArrow(run, "at int, " + ", ".join(f"c{i} double" for i in range(k))).groupBy("at").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(k)]).collect()
        out = np.zeros_like(block)
        for r in sums:
            out[r["at"]] = r[1:]
        return out / centre.n

    return times


def _orthonormal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The block's part outside the basis, as orthonormal columns; those that vanish are left out."""
    for _ in range(3):
        block = block / np.maximum(np.linalg.norm(block, axis=0), 1e-300)
        block = block - basis @ (basis.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-8]
    return block


def minres(times: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int, enough: float) -> np.ndarray:
    """Approximate solutions of ``times(t) = right``, the columns side by side in lockstep, so that a step is
    one product for all of them. Ends when each residual is ``enough`` of its start, or after ``steps``."""
    norm = np.linalg.norm(right, axis=0)
    beta, start = norm.copy(), norm.copy()
    safe = lambda x: np.where(x == 0, 1.0, x)
    v, before = right / safe(beta), np.zeros_like(right)
    out, d, d_before = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    eta = beta.copy()
    c, c_before, s, s_before = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    last = np.zeros_like(beta)
    for _ in range(steps):
        w = times(v)
        alpha = (v * w).sum(0)
        w = w - alpha * v - last * before
        following = np.linalg.norm(w, axis=0)
        # the new column of the tridiagonal matrix through the two rotations before, then its own
        top = s_before * last
        middle = c_before * last
        second = c * middle + s * alpha
        third = -s * middle + c * alpha
        length = np.hypot(third, following)
        c_new, s_new = np.where(length == 0, 1.0, third / safe(length)), following / safe(length)
        step = (v - second * d - top * d_before) / safe(length)
        out = out + np.where(length == 0, 0.0, c_new * eta) * step
        eta = -s_new * eta
        d_before, d = d, step
        c_before, c, s_before, s = c, c_new, s, s_new
        before, v, last = v, w / safe(following), following
        if (np.abs(eta) <= enough * start).all():
            break
    return out


def leading_pairs(times: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, steps: int = 4, rounds: int = 200, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues and unit eigenvectors of the symmetric operator of ``times``.

    A subspace is searched by Rayleigh-Ritz; each pair whose residual isn't yet at double precision gives a
    correction, an inner MINRES solution of the equation projected off the locked and the wanted Ritz
    vectors, which widens the subspace. A pair at double precision is locked: it stays in the projection
    and is corrected no more. A subspace that is full starts again from its best Ritz vectors.
    """
    wanted = min(wanted, size)
    rng = np.random.default_rng(seed)
    basis = _orthonormal(rng.normal(size=(size, min(size, 2 * wanted))), np.zeros((size, 0)))
    image = times(basis)
    best, kept, idle = np.inf, None, 0
    for _ in range(rounds):
        small = basis.T @ image
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        ritz = basis @ turns[:, :wanted]
        left = image @ turns[:, :wanted] - ritz * values[:wanted]
        size_of = np.linalg.norm(left, axis=0) / max(abs(values[0]), 1e-300)
        idle = 0 if size_of.max() < best / 2 else idle + 1
        if size_of.max() < best:
            best, kept = size_of.max(), (values[:wanted].copy(), ritz)
        if best < 1e-12 and idle > 3:  # what rounding of the sums leaves is reached
            break
        loose = np.flatnonzero(size_of > 4 * np.finfo(float).eps * np.sqrt(size))
        if not len(loose) or basis.shape[1] == size and size_of.max() < 1e-13:
            break
        if basis.shape[1] + len(loose) > max(6 * wanted, 3 * wanted + 8) and basis.shape[1] < size:
            basis, image = basis @ turns[:, : 3 * wanted], image @ turns[:, : 3 * wanted]
        theta = values[loose]
        off = lambda x: x - ritz @ (ritz.T @ x)  # noqa: B023, E731
        correction = minres(lambda x: off(times(y := off(x)) - y * theta), off(-left[:, loose]), steps, 0.05)  # noqa: B023
        more = _orthonormal(correction, basis)
        if not more.shape[1]:
            break
        basis = np.hstack([basis, more])
        image = np.hstack([image, times(more)])
    values, ritz = kept
    if best > 1e-11:
        raise RuntimeError(f"the eigenvectors' residuals stay at {best:.1e}")
    return values, ritz


def whiten(vectors: DataFrame, components: int = 16, scale: float = 64.0) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: each row on the leading
    components of the covariance of the distinct integer vectors.

    One row per row whose vector is there and finite, and component; repeated rows and rows without an id
    too, but each vector counts once in the fit. Components whose variance is zero to double precision are
    left out: there are none where all vectors are one. Vectors of several lengths, or with components
    beyond 32 bits, fail the job with a message. No such rows: no rows. Other columns are ignored.
    """
    rows = finite(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    spark = rows.sparkSession
    fit = fit_list(rows, scale)
    centre = centre_of(fit)
    size = len(centre.sums)
    times = covariance_times(fit, centre)
    values, axes = leading_pairs(times, size, components) if size and centre.n > 1 else (np.zeros(0), np.zeros((0, 0)))
    there = values > max(values.max(initial=0) * 1e-12, 1e-12)
    values, axes = values[there], axes[:, there]
    if not len(values):
        return spark.createDataFrame([], WHITENED)
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(values))])
    whitening = axes / np.sqrt(values)
    identity_error = float(np.abs(whitening.T @ times(whitening) - np.eye(len(values))).max())
    explained = values / trace_of(fit, centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                x = _integers(batch, scale)
                n = len(x)
                spread = np.repeat(np.arange(n), k)
                fixed = [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, centre.n)), pa.array(centre.deviations(x), pa.int64()).take(pa.array(spread))]
                said = [pa.array((centre.off(x) @ whitening).ravel()), pa.array(np.tile(explained, n)), pa.array(np.full(n * k, identity_error))]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(spread)), *fixed, *said], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, WHITENED)


def trace_of(fit: DataFrame, centre: Centre) -> float:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(float((c * c).sum()) for batch in batches for x in _unpacked(batch) for c in [centre.off(x)])
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["total"])

    return fit.mapInArrow(run, "total double").agg(F.sum("total")).first()[0] / centre.n
